"""Byte-level BPE encoding with content-defined chunk reuse, and decoding.

1. Each distinct text is cut into chunks by a rolling hash; only the hashes of
   the chunks are grouped. A chunk that stands in several texts is shared, and
   the text with the smallest key owns it.
2. The owner's task encodes the chunk, once; its ids go to all texts that hold
   it. Chunks of one text alone are encoded where the text is put together.
3. A chunk's own ids hold from its begin up to its last certain word end. At
   each join the rest of one chunk is encoded again together with the head of
   the next one, further and further, until a word ends where one does in the
   next chunk's own ids: from there on these are exact.

A word (the piece of text that merges can't leave) is found from left to right
and looks at most one character beyond its end and the next; so an end that
lies two characters or more before the end of what was read is certain.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skytally.lineage import stash
from skytally.llm.chunks import BITS, LEAST, MOST, chunk_ends

#: Fixed value: how byte-level BPE parts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text of ASCII characters alone.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Words in each of the two halves of the memory for words.
KNOWN_WORDS = 1 << 16
KNOWN_LENGTH = 64
HEAD = 64
#: Chunks of one text that are encoded as one at most.
RUN = 64
#: Rows whose texts and ids a task holds as Python objects at once.
ROWS = 256


def _letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_LETTERS = _letters()
_BYTE = {c: b for b, c in enumerate(_LETTERS)}


class _Known(dict):
    """Ids of words (4 bytes each, little-endian), worked out when first asked for; of bounded size.

    When it is full it becomes the older half, and words asked for again come back from there.
    """

    def __init__(self, model):
        self.model, self.older = model, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            # printable ASCII characters stand for themselves
            letters = word.replace(" ", _LETTERS[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_LETTERS)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Coder:
    """Encodes chunks and joins them; `spec` is the content of a tokenizer file."""

    def __init__(self, spec: str, bits: int = BITS, least: int = LEAST, most: int = MOST):
        kind = json.loads(spec)
        before = kind["pre_tokenizer"] or {}
        if kind["model"]["type"] != "BPE" or kind["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.size = self.library.model, (bits, least, most)
        self.ids = _Known(self.model)
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in kind["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.word, self.ascii_word = regex.compile(WORDS), re.compile(ASCII_WORDS)

    def parts(self, text: str) -> list[bytes | list[bytes]]:
        """Ids of a special token, or the chunks of the text between two of them."""
        out = []
        for piece in self.at_special.split(text) if self.at_special else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                data = piece.encode()
                ends = chunk_ends(data, *self.size)
                out.append([data[a:b] for a, b in zip([0, *ends], ends)])
        return out

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_word.findall(text)
        # only code points that are not assigned yet are classed unlike the library's
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.word.findall(text)

    def encode(self, text: str) -> bytes:
        return b"".join([self.ids[w] for w in self.words(text)])

    def chunk(self, text: str) -> tuple[bytes, int, int]:
        """Ids of a chunk by itself, its last certain word end, and the bytes of ids before that."""
        words = self.words(text)
        ids = [self.ids[w] for w in words]
        k, end, after = len(words), len(text), 0
        while k and end > len(text) - 2:
            k -= 1
            end -= len(words[k])
            after += len(ids[k])
        ids = b"".join(ids)
        return ids, end, len(ids) - after

    def _meet(self, pending: str, text: str) -> tuple[bytes, int] | None:
        """Ids from the begin of `pending` to a word end within `text` that is one of its own too, and the bytes of its own ids before it."""
        width = HEAD
        while True:
            head, at, skip = text[:width], 0, 0
            own = {0: 0}
            for w in self.words(head):
                at += len(w)
                if at > len(head) - 2:
                    break
                skip += len(self.ids[w])
                own[at] = skip
            both, at, ids = pending + head, 0, []
            for w in self.words(both):
                if at >= len(pending) and at - len(pending) in own:
                    return b"".join(ids), own[at - len(pending)]
                at += len(w)
                if at > len(both) - 2:
                    break
                ids.append(self.ids[w])
            if width >= len(text):
                return None
            width *= 4

    def joined(self, texts: list[str], made: list[tuple[bytes, int, int]]) -> bytes:
        """Ids of the whole text from those of its chunks."""
        ids, end, size = made[0]
        out, pending, i, more = [ids[:size]], texts[0][end:], 1, 1
        while i < len(texts):
            met = self._meet(pending, texts[i])
            if met is None:
                # no agreement in the whole chunk: twice as many are taken each time, so that a word of any length costs little
                pending, i, more = pending + "".join(texts[i:i + more]), i + more, more * 2
                continue
            ids, end, size = made[i]
            out += [met[0], ids[met[1]:size]]
            pending, i, more = texts[i][end:], i + 1, 1
        out.append(self.encode(pending))
        return b"".join(out)

    def whole(self, text: str, known: dict[int, tuple[bytes, int, int]]) -> bytes:
        """Ids of a text; `known` has chunks by their number that were encoded elsewhere."""
        out, at = [], 0
        for part in self.parts(text):
            if isinstance(part, bytes):
                out.append(part)
                continue
            # chunks of this text alone that follow each other are encoded as one
            texts, made = [], []
            for (lent, _), run in groupby(range(len(part)), lambda k: (at + k in known, k // RUN)):
                if lent:
                    for k in run:
                        texts.append(part[k].decode())
                        made.append(known[at + k])
                else:
                    texts.append(b"".join([part[k] for k in run]).decode())
                    made.append(None)
            at += len(part)
            if made == [None]:
                out.append(self.encode(texts[0]))
            else:
                out.append(self.joined(texts, [m or self.chunk(t) for t, m in zip(texts, made)]))
        return b"".join(out)


@lru_cache(1)
def _coder(spec: str) -> Coder:
    """One for all tasks of a Python worker."""
    return Coder(spec)


@lru_cache(1)
def _token_bytes(spec: str) -> list[bytes]:
    """The bytes of each token."""
    kind = json.loads(spec)
    own = {t["id"]: t["content"].encode() for t in kind["added_tokens"]}
    out = [b""] * (1 + max([*kind["model"]["vocab"].values(), *own]))
    for token, i in kind["model"]["vocab"].items():
        out[i] = bytes(_BYTE[c] for c in token)
    for i, content in own.items():
        out[i] = content
    return out


def text_of(ids: bytes, spec: str) -> str:
    table = _token_bytes(spec)
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _few(batches):
    """The same rows in small batches, so that few of them are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _texts(column: pa.Array) -> list[str]:
    return ["" if v is None else v.decode("utf-8", "replace") for v in column.to_pylist()]


def _keyed(docs: DataFrame) -> DataFrame:
    """`doc_id, h1, h2, data`: texts as bytes (NULL: empty), told apart by two 64-bit hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    return rows.select("doc_id", F.xxhash64("data").alias("h1"), F.xxhash64("data", F.lit(1)).alias("h2"), "data")


def _hash_halves(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(data)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    table = np.array(rows, np.int64).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array(table[:, c]) for c in range(len(names))], names=names)


def encodings(docs: DataFrame, spec: str) -> DataFrame:
    """`h1, h2, ids` of each distinct text of `docs(text, ...)`; the keys are those that `encoded` joins by.

    `ids` has four bytes a token, little-endian.
    """
    shared_spec = docs.sparkSession.sparkContext.broadcast(spec)
    texts = _keyed(docs).select("h1", "h2", "data")

    def cut(batches):
        coder, names = _coder(shared_spec.value), ["h1", "h2", "at", "c1", "c2"]
        for batch in _few(batches):
            rows = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))):
                chunks = [c for part in coder.parts(text) if isinstance(part, list) for c in part]
                rows += [(a, b, k, *_hash_halves(c)) for k, c in enumerate(chunks)]
            yield _longs(rows, names)

    def pack(batches):
        small = zstandard.ZstdCompressor(level=3)
        for batch in _few(batches):
            packed = [small.compress(v) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["h1", "h2", "packed"])

    pieces = stash(texts.mapInArrow(cut, "h1 long, h2 long, at long, c1 long, c2 long").distinct(), "pieces")
    text = F.struct("h1", "h2")
    shared = stash(pieces.groupBy("c1", "c2").agg(F.min(text).alias("owner"), F.max(text).alias("last")).filter("owner < last").select("c1", "c2", "owner"), "shared")
    uses = stash(pieces.join(shared, ["c1", "c2"]).select("h1", "h2", "at", "c1", "c2", (text == F.col("owner")).alias("own")), "uses")
    owned = uses.filter("own").groupBy("h1", "h2").agg(F.collect_list(F.struct("at", "c1", "c2")).alias("owned"))
    # both uses of the packed texts keep all their rows, so that one exchange serves them
    packed = texts.mapInArrow(pack, "h1 long not null, h2 long not null, packed binary not null").groupBy("h1", "h2").agg(F.first("packed").alias("packed"))

    def encode_owned(batches):
        coder, open_ = _coder(shared_spec.value), zstandard.ZstdDecompressor()
        for batch in _few(batches):
            rows = []
            for packed, owned in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not owned:
                    continue
                chunks = [c for part in coder.parts(_unpacked(open_, packed)) if isinstance(part, list) for c in part]
                done = set()
                for o in owned:
                    # a chunk may stand in its owner several times
                    if (key := (o["c1"], o["c2"])) not in done:
                        done.add(key)
                        rows.append((*key, *coder.chunk(chunks[o["at"]].decode())))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["c1", "c2", "ids", "end", "size"])

    made = packed.join(owned, ["h1", "h2"], "left").mapInArrow(encode_owned, "c1 long, c2 long, ids binary, end long, size long")
    lent = uses.select("h1", "h2", "at", "c1", "c2").join(made, ["c1", "c2"]).groupBy("h1", "h2").agg(F.collect_list(F.struct("at", "ids", "end", "size")).alias("lent"))

    def put_together(batches):
        coder, open_ = _coder(shared_spec.value), zstandard.ZstdDecompressor()
        for batch in _few(batches):
            ids = []
            for packed, lent in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ids.append(coder.whole(_unpacked(open_, packed), {r["at"]: (r["ids"], r["end"], r["size"]) for r in lent or ()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["h1", "h2", "ids"])

    return packed.join(lent, ["h1", "h2"], "left").mapInArrow(put_together, "h1 long, h2 long, ids binary")


def _unpacked(open_: zstandard.ZstdDecompressor, packed: bytes) -> str:
    return open_.decompress(packed).decode("utf-8", "replace")


def decoded(encodings: DataFrame, spec: str) -> DataFrame:
    """The rows with a column `decoded`, the text that `ids` stand for; NULL ids give NULL.

    Bytes that are no UTF-8 become replacement characters, as in the library; special tokens give their content.
    """
    shared_spec, at = encodings.sparkSession.sparkContext.broadcast(spec), encodings.columns.index("ids")

    def run(batches):
        for batch in _few(batches):
            text = pa.array([None if v is None else text_of(v, shared_spec.value) for v in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encodings.schema)
    return encodings.mapInArrow(run, f"{fields}, decoded string")


def per_document(docs: DataFrame, by_text: DataFrame) -> DataFrame:
    """`doc_id` and the columns of `by_text(h1, h2, ...)` for each row of `docs`.

    Both are written first, so that a text with very many copies can be split in the join.
    """
    rows = stash(_keyed(docs).select("doc_id", "h1", "h2"), "rows")
    return rows.join(stash(by_text, "by_text"), ["h1", "h2"]).drop("h1", "h2")


def encoded(docs: DataFrame, spec: str) -> DataFrame:
    """`doc_id, ids` for each row of `docs(doc_id, text, ...)`, equal to what the tokenizers library gives.

    `ids` has four bytes a token, little-endian. A NULL or empty text has none.
    Repeated rows and NULL ids are kept; equal texts are encoded once. The
    content of a special token counts as that token. Other columns, whatever
    their names, are not read; an empty table gives no rows.
    """
    return per_document(docs, encodings(docs, spec))


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` of each row's encoding and of the text decoded from it."""
    both = decoded(encodings(docs, spec), spec)
    by_text = both.select("h1", "h2", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
    return per_document(docs, by_text)
