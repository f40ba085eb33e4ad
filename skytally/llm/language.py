"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds the vectors of
its letters, rotated by their place, into their product; a text bundles
(sums) its trigrams, and a language bundles the unit vectors of its texts.
A text has the language whose prototype makes the largest cosine with it.

Runs of anything but letters count as one blank, letters are lower-cased, and
letters beyond a-z share 37 symbols by code point, so that the alphabet, and
with it every table here, has a fixed size whatever the scripts of the corpus.
Greek or Cyrillic letters nearly all keep symbols of their own; of scripts with thousands of
letters hundreds share one, so such languages are told apart by how often runs of symbols occur.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.rows import keep_rows

DIMENSIONS = 1024
SYMBOLS = 64
SEED = 7
SHARPNESS = 25.0
SAMPLE_PER_LANGUAGE = 4000
UNKNOWN = "und"
LEAST_SCORE, LEAST_COSINE = 0.4, 0.05
#: Distinct trigrams from which the bounds hold in full (about ten words); they fall in proportion below.
ENOUGH = 60
_PIECE = 1 << 20
_UNIT = 1 << 20


@lru_cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the symbols, and the symbol of each code point (0: no letter)."""
    vectors = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    symbol = np.zeros(0x110000, np.uint8)
    # from here on no plane holds letters
    for cp in range(0x40000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            v = ord(low[0])
            symbol[cp] = v - 96 if 97 <= v <= 122 else 27 + v % 37
    return vectors, symbol


def _trigram_vectors(codes: np.ndarray) -> np.ndarray:
    vectors, _ = _letters()
    a, b, c = codes // (SYMBOLS * SYMBOLS), codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]


def _trigrams(text: str) -> np.ndarray:
    """Counts of the distinct trigrams of a text as rows `code, count`; blanks surround it."""
    _, symbol = _letters()
    total, tail = np.zeros((0, 2), np.int64), np.zeros(1, np.uint8)
    for at in range(0, len(text), _PIECE):
        piece = text[at:at + _PIECE].encode("utf-32-le", "replace")
        s = np.concatenate([tail, symbol[np.frombuffer(piece, np.uint32)], np.zeros(int(at + _PIECE >= len(text)), np.uint8)])
        s = s[np.concatenate([[True], (s[1:] | s[:-1]) != 0])].astype(np.int32)
        # the last two symbols go on in the next piece
        codes, n = np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True)
        if len(total):
            codes, back = np.unique(np.concatenate([total[:, 0], codes]), return_inverse=True)
            n = np.bincount(back, np.concatenate([total[:, 1], n])).astype(np.int64)
        total = np.stack([codes, n], axis=1)
        tail = s[-2:].astype(np.uint8)
    return total


def _vectors(texts: list[str | None]):
    """Blocks `rows, vectors, trigrams` of the texts that hold letters; rows index the texts, trigrams are their distinct ones."""
    block, held = [], []

    def made():
        used = np.unique(np.concatenate([c[:, 0] for c in block]))
        counts = np.zeros((len(block), len(used)), np.float32)
        for r, c in enumerate(block):
            counts[r, np.searchsorted(used, c[:, 0])] = c[:, 1]
        out = np.zeros((len(block), DIMENSIONS), np.float64)
        for lo in range(0, len(used), 4096):  # bounded tables also where every trigram occurs
            out += counts[:, lo:lo + 4096] @ _trigram_vectors(used[lo:lo + 4096]).astype(np.float32)
        return np.array(held), out, np.array([len(c) for c in block])

    for row, text in enumerate(texts):
        c = _trigrams(text) if text else np.zeros((0, 2), np.int64)
        # a trigram with a letter has a code above 0; a text of other signs gives at most blanks
        c = c[c[:, 0] > 0]
        if not len(c):
            continue
        block.append(c)
        held.append(row)
        if len(block) == 256:
            yield made()
            block, held = [], []
    if block:
        yield made()


def prototypes(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototype vectors, from `labelled(doc_id, text, lang)`.

    Rows without language or text teach nothing. Of each language about
    `sample` rows at most are used, picked by a hash of doc_id, so that rows
    picked don't depend on how the table is stored. Bundles are sums of whole
    numbers, equal in any order of the rows.
    """
    labelled = labelled.filter("lang is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, DIMENSIONS))
    names = sorted(counts)
    span = 1 << 30
    rate = F.lit(None)
    for name in names:
        rate = F.when(F.col("lang") == name, F.lit(int(min(1.0, sample / counts[name]) * span))).otherwise(rate)
    picked = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < rate).select("lang", "text")

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sums: dict[str, np.ndarray] = {}
            for rows, vec, _ in _vectors(texts):
                size = np.sqrt((vec * vec).sum(axis=1, keepdims=True))
                vec = np.rint(vec / np.maximum(size, 1) * _UNIT).astype(np.int64)
                for r, v in zip(rows, vec):
                    sums[langs[r]] = sums.get(langs[r], 0) + v
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))})

    parts = picked.mapInArrow(run, "lang string, v array<long>")
    # one row for each language and dimension: as many whatever the corpus
    rows = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    names = sorted({r.lang for r in rows})
    out = np.zeros((len(names), DIMENSIONS))
    for r in rows:
        out[names.index(r.lang), r.i] = r.x
    return names, out


def _unit(protos: np.ndarray) -> np.ndarray:
    return protos / np.maximum(np.sqrt((protos * protos).sum(axis=1, keepdims=True)), 1e-30) if len(protos) else protos


def _scored(texts: list[str | None], langs: list[str], unit: np.ndarray):
    """Blocks `rows, language, score, cosine, trigrams` of the texts that hold letters."""
    for rows, vec, size in _vectors(texts) if langs else ():
        c = (vec @ unit.T) / np.sqrt(np.maximum((vec * vec).sum(axis=1, keepdims=True), 1e-30))
        top = c.max(axis=1)
        yield rows, np.array(langs, object)[c.argmax(axis=1)], 1 / np.exp(SHARPNESS * (c - top[:, None])).sum(axis=1), top, size


def identify(docs: DataFrame, names: list[str], protos: np.ndarray) -> DataFrame:
    """`doc_id, lang_pred, score, cosine` for each row of `docs(doc_id, text, ...)`.

    `lang_pred` is `und` with score 0 if the text is NULL or empty, holds no
    letter, or nothing was learned. Otherwise `score` is the softmax of the cosines at
    the winning language (1 divided by the number of languages at least), ties
    going to the language first in order. Repeated rows get equal results;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((list(names), _unit(protos)))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            pred, score, cosine = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
            for rows, *found in _scored(batch.column(1).to_pylist(), *shared.value):
                pred[rows], score[rows], cosine[rows] = found[:3]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(cosine)],
                                             names=["doc_id", "lang_pred", "score", "cosine"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, cosine double"))


def known_language(docs: DataFrame, names: list[str], protos: np.ndarray, least_score: float = LEAST_SCORE, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """The rows of `docs`, all columns, whose text is in a learned language.

    Rejected are texts that are NULL or without letters, and texts whose
    cosine or score stays below the bounds, which are no prose in any of the
    languages. Short texts tell less, so their bounds are lower, by their
    number of distinct trigrams. Repeated rows are decided alike; an empty table
    gives no rows, and without a learned language none is kept. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast((list(names), _unit(protos)))

    def keep(texts):
        ok = np.zeros(len(texts), bool)
        for rows, _, score, cosine, size in _scored(texts, *shared.value):
            share = np.minimum(size / ENOUGH, 1)
            ok[rows] = (score >= least_score * share) & (cosine >= least_cosine * share)
        return ok

    return keep_rows(docs, keep)


def held_out() -> F.Column:
    """Documents that languages are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def language_of(docs: DataFrame) -> DataFrame:
    """Prototypes learned from the documents not held out, applied to all: `doc_id, held_out, lang_pred, score, cosine`.

    A row without doc_id is not held out, and nothing is learned from it.
    """
    names, protos = prototypes(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, names, protos).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "cosine")
