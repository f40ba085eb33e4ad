"""Quality classifier: a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks of 512 bytes that cover all of it. In a
chunk each byte is embedded, learned filters run over it, and each
filter's largest activation goes through a hidden layer into the chunk's
logit. A logistic layer combines mean, largest and smallest logit of all
chunks into one probability.

The network is learned on a bounded sample of labelled texts (parameters
`sample` and `per_text`) on the driver; scoring reads every byte of every text
in one pass over the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, ADVANCE = 512, 384
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 10, 4, 32, 24
SAMPLE_PER_CLASS = 2500
CHUNKS_PER_TEXT = 6
STEPS, BATCH, RATE = 700, 64, 4e-3
SEED = 5
BLOCK = 256
GOOD = 0.7


@dataclass
class Network:
    """Weights of the chunk network, and of the layer that combines chunks."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    combine: np.ndarray = field(default_factory=lambda: np.array([1.0, 0, 0, 0]))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.w1, self.b1, self.w2, self.b2]


def chunks(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the text, the last one filled up with zeros; one chunk for an empty text."""
    n = 1 + max(0, -(-(len(text) - CHUNK) // ADVANCE))
    data = np.zeros((n - 1) * ADVANCE + CHUNK, np.uint8)
    data[:len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::ADVANCE]


def _start(rng: np.random.Generator) -> Network:
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    wide = WIDTH * EMBED
    return Network(normal(256, EMBED, scale=0.5), normal(wide, FILTERS, scale=(2 / wide) ** 0.5), np.zeros(FILTERS, np.float32),
                   normal(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), np.zeros(HIDDEN, np.float32),
                   normal(HIDDEN, 1, scale=HIDDEN**-0.5), np.zeros(1, np.float32))


def _pooled(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, largest activation of each filter, and where it is."""
    e = net.embed[x].reshape(len(x), CHUNK * EMBED)
    windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]
    z = (np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ net.kernel).reshape(len(x), -1, FILTERS)
    at = z.argmax(axis=1)
    return windows, np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + net.bias, at


def chunk_logits(net: Network, x: np.ndarray) -> np.ndarray:
    e = net.embed[x].reshape(len(x), CHUNK * EMBED)
    windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]
    z = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ net.kernel
    top = z.reshape(len(x), -1, FILTERS).max(axis=1) + net.bias
    hidden = np.maximum(np.maximum(top, 0) @ net.w1 + net.b1, 0)
    return (hidden @ net.w2 + net.b2)[:, 0]


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    windows, top, at = _pooled(net, x)
    a = np.maximum(top, 0)
    u = a @ net.w1 + net.b1
    h = np.maximum(u, 0)
    logit = (h @ net.w2 + net.b2)[:, 0]
    d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)[:, None]
    du = d @ net.w2.T * (u > 0)
    dtop = du @ net.w1.T * (top > 0)
    seen = windows[np.arange(len(x))[:, None], at]                       # chunk, filter, window
    dkernel = np.einsum("nfk,nf->kf", seen, dtop)
    back = (dtop[:, :, None] * net.kernel.T[None]).reshape(-1, EMBED)
    where = (at * STRIDE)[:, :, None] + np.arange(WIDTH)
    byte = x[np.arange(len(x))[:, None, None], where].ravel()
    dembed = np.stack([np.bincount(byte, back[:, k], 256) for k in range(EMBED)], axis=1)
    return [dembed, dkernel, dtop.sum(0), a.T @ du, du.sum(0), h.T @ d, d.sum(0)]


def learn(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """The chunk network, by Adam on batches with as many chunks of either class."""
    rng = np.random.default_rng(seed)
    net = _start(rng)
    moment, square = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    sides = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    for step in range(1, STEPS + 1):
        rows = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for p, g, m, v in zip(net.parts(), _gradients(net, x[rows], y[rows]), moment, square):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return net


def _summaries(net: Network, texts: list[bytes]) -> np.ndarray:
    """One row `1, mean, largest, smallest logit` for each text; chunks of several texts go through the network together."""
    sums = np.zeros((len(texts), 4))
    sums[:, 2], sums[:, 3] = -np.inf, np.inf
    held, owner, count = [], [], 0

    def flush():
        logit, own = chunk_logits(net, np.concatenate(held)), np.repeat([o for o, _ in owner], [n for _, n in owner])
        np.add.at(sums, (own, 0), 1)
        np.add.at(sums, (own, 1), logit)
        np.maximum.at(sums, (own, 2), logit)
        np.minimum.at(sums, (own, 3), logit)

    for i, text in enumerate(texts):
        c = chunks(text)
        for lo in range(0, len(c), BLOCK):
            held.append(c[lo:lo + BLOCK])
            owner.append((i, len(held[-1])))
            count += len(held[-1])
            if count >= BLOCK:
                flush()
                held, owner, count = [], [], 0
    if held:
        flush()
    sums[:, 1] /= np.maximum(sums[:, 0], 1)
    sums[:, 0] = 1
    return sums


def _combined(rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the logistic layer, by Newton steps with a small ridge."""
    rows = np.clip(rows, -30, 30)
    w = np.array([0, 1.0, 0, 0])
    weight = weight / weight.sum()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        g = rows.T @ (weight * (p - y)) + 1e-3 * w
        hess = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(4)
        w = w - np.linalg.solve(hess, g)
    return w


def _bytes(column: pa.Array) -> list[bytes]:
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS, per_text: int = CHUNKS_PER_TEXT, seed: int = SEED) -> Network | float:
    """A network from `docs(doc_id, text)` and `labels(doc_id, quality)`, whose quality is 0, 1 or NULL.

    About `sample` labelled documents of each class at most, picked by a hash
    of doc_id, teach `per_text` chunks each at most; of rows that repeat an id the first text in order, of its labels the larger, counts. Without examples of both
    classes there is nothing to tell apart: then the result is the share of 1
    among the labels (one half without any), which is every text's score.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    counts = {r.quality: r.n for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    span = 1 << 30
    rate = F.when(F.col("quality") == 1, int(min(1.0, sample / counts[1]) * span)).otherwise(int(min(1.0, sample / counts[0]) * span))
    # at most about two samples of ids, whatever the size of the tables
    picked = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < rate).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # one text an id, so that repeated rows send no more than the sample
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def cut(batches):
        for batch in batches:
            y, out, ids = [], [], []
            for d, t, q in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist()):
                c = chunks(t)
                if len(c) > per_text:
                    c = c[np.sort(np.random.default_rng(d % (1 << 32)).choice(len(c), per_text, replace=False))]
                out += [row.tobytes() for row in c]
                y += [q] * len(c)
                ids += [d] * len(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(y, pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "quality", "chunk"])

    rows = texts.select("doc_id", "text", "quality").mapInArrow(cut, "doc_id long, quality int, chunk binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("chunk", "ascending")]).combine_chunks()
    y = rows.column(1).to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return (counts[1] + 1) / (sum(counts.values()) + 2)
    x = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(-1, CHUNK)
    net = learn(x, y, seed)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def summed(batches):
        for batch in batches:
            s = _summaries(shared.value, _bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(s[:, c]) for c in (1, 2, 3))], names=["doc_id", "quality", "mean", "most", "least"])

    got = texts.select("doc_id", "text", "quality").mapInArrow(summed, "doc_id long, quality int, mean double, most double, least double").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("mean", "ascending")])
    s = np.stack([np.ones(len(got)), *(got.column(c).to_numpy() for c in (2, 3, 4))], axis=1)
    y = got.column(1).to_numpy().astype(float)
    net.combine = _combined(s, y, np.where(y == 1, counts[1] / max(y.sum(), 1), counts[0] / max((1 - y).sum(), 1)))
    return net


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """`doc_id, score, predicted` of each row of `docs(doc_id, text, ...)`; a NULL text scores as an empty one.

    Equal texts score equally, repeated rows and NULL ids are kept, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            net = shared.value
            if isinstance(net, Network):
                logit = np.clip(_summaries(net, _bytes(batch.column(1))), -30, 30) @ net.combine
                # sums in single precision differ by what stands beside a text in its block
                p = np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 6)
            else:
                p = np.full(batch.num_rows, net)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= GOOD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double, predicted int"))


def held_out() -> F.Column:
    """Documents whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def quality_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A network learned from the labels not held out, applied to all documents: `doc_id, held_out, score, predicted`."""
    model = train(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
