"""Quality scores from random-indexing word vectors and a two-layer network.

Random indexing: every token has a fixed sparse random index vector (a few +1 and -1
places, from its hash); a word's vector is the sum of the index vectors of the tokens
around it in all documents. A document pools the unit vectors of its tokens. A two-layer
network maps the pooled vector to a log-odds, which a temperature fitted on rows apart
from the training rows turns into a calibrated probability.

Words are counted in a table of fixed size by hash, so the vectors are a matrix of known
size however many words there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import run_hashes, ship, slices, text_bytes
from splitscope.session import ensure_short_batches

_WINDOW = 1 << 19  # bytes of text worked on at once

# Bytes by kind: 0 white space, 1 part of a word, 2 a sign that is a token of its own.
_KIND = np.full(256, 1, dtype=np.int8)
_KIND[[*range(0, 33), 127]] = 0
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2


@dataclass(frozen=True)
class Shape:
    """Sizes of the random index: table rows, vector length, places set in an index vector, window."""

    buckets: int = 1 << 15
    dim: int = 32
    places: int = 4
    reach: int = 2
    seed: int = 42

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Per bucket the places set in its index vector, and their signs."""
        rng = np.random.default_rng(self.seed)
        where = np.argsort(rng.random((self.buckets, self.dim)), axis=1)[:, : self.places]
        return where.astype(np.int64), rng.choice([-1.0, 1.0], size=where.shape)


def tokens(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every token of texts lying in a row: words, and signs by themselves."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = (kind == 2) | ((kind == 1) & (np.concatenate([[0], kind[:-1]]) != 1)) | ((kind == 1) & edge[:-1])
    start = np.flatnonzero(begins)
    stops = np.concatenate([(kind[1:] != kind[:-1]) | (kind[1:] == 2), [True]]) | edge[1:]
    end = np.flatnonzero(stops & (kind > 0)) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    return (run_hashes(data, start, end) % np.uint64(buckets)).astype(np.int64), text


def spans(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``_WINDOW`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _WINDOW, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def batches_of(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of texts: first, last + 1, and their tokens (bucket, text counted from the first)."""
    data, offsets = text_bytes(pc.utf8_lower(column.fill_null("")))
    for lo, hi in spans(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        yield lo, hi, *tokens(data[offsets[lo] : offsets[hi]], own, buckets)


def word_vectors(docs: DataFrame, shape: Shape = Shape()) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and token counts of the words of all ``docs``, as tables of ``shape``.

    Each task sums its tokens into one table and sends it in blocks of rows; blocks are
    added in two steps (by block and group of tasks, then by block), so no task receives
    a block from every other. The result, of fixed size, goes to the driver.
    """
    ship(docs.sparkSession)
    ensure_short_batches(docs.sparkSession)
    size = shape.buckets * shape.dim
    block = 512

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, sign = shape.index()
        table, count = np.zeros(size), np.zeros(shape.buckets)
        seen = False
        for batch in slices(batches):
            for _, _, word, text in batches_of(batch.column(0), shape.buckets):
                seen = True
                count += np.bincount(word, minlength=shape.buckets)
                for step in range(1, shape.reach + 1):
                    same = text[step:] == text[:-step]
                    left, right = word[:-step][same], word[step:][same]
                    for a, b in ((left, right), (right, left)):
                        for k in range(shape.places):
                            table += np.bincount(a * shape.dim + where[b, k], weights=sign[b, k], minlength=size)
        if seen:
            rows = np.concatenate([table.reshape(shape.buckets, shape.dim), count[:, None]], axis=1)
            yield _blocks(rows, block, TaskContext.get().partitionId() % 32)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, g, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = np.frombuffer(raw, dtype=np.float32).astype(np.float64)
                sums[b, g] = sums[b, g] + got if (b, g) in sums else got
        if sums:
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([0] * len(keys)), pa.array([sums[k].astype(np.float32).tobytes() for k in keys], pa.binary())],
                names=["block", "grp", "sums"],
            )

    schema = "block bigint, grp bigint, sums binary"
    parts = docs.select("text").mapInArrow(add, schema).repartition("block", "grp").mapInArrow(total, schema)
    rows = parts.repartition("block").mapInArrow(total, schema).collect()
    out = np.zeros((shape.buckets, shape.dim + 1))
    for r in rows:
        out[r["block"] * block : (r["block"] + 1) * block] += np.frombuffer(r["sums"], dtype=np.float32).reshape(-1, shape.dim + 1)
    return out[:, :-1], out[:, -1]


def _blocks(rows: np.ndarray, block: int, group: int) -> pa.RecordBatch:
    n = -(-len(rows) // block)
    raw = [rows[i * block : (i + 1) * block].astype(np.float32).tobytes() for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([group] * n, pa.int64()), pa.array(raw, pa.binary())], names=["block", "grp", "sums"])


@dataclass
class Quality:
    """Word vectors (unit length, float32), the network's weights and the temperature."""

    shape: Shape
    vectors: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
    temperature: float = 1.0

    def pooled(self, column: pa.Array) -> np.ndarray:
        """Per text: weighted mean and spread of its word vectors, and agreement of neighbours.

        Frequent words weigh less (a / (a + frequency)). The last entries are the mean
        product of adjacent words' vectors place by place and the length of the mean.
        """
        d = self.shape.dim
        out = np.zeros((len(column), 3 * d + 2), dtype=np.float32)
        for lo, hi, word, text in batches_of(column, self.shape.buckets):
            if not len(word):
                continue
            vec, w = self.vectors[word], self.weight[word]
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            own = lo + text[first]
            n = np.diff(np.append(first, len(word))).astype(np.float32)
            share = np.add.reduceat(w, first)
            mean = np.add.reduceat(vec * w[:, None], first, axis=0) / share[:, None]
            square = np.add.reduceat(vec * vec * w[:, None], first, axis=0) / share[:, None]
            beside = np.zeros_like(vec)
            beside[:-1] = vec[:-1] * vec[1:]
            beside[np.append(first[1:], len(word)) - 1] = 0
            out[own, :d] = mean
            out[own, d : 2 * d] = np.sqrt(np.maximum(square - mean * mean, 0))
            out[own, 2 * d : 3 * d] = np.add.reduceat(beside, first, axis=0) / n[:, None]
            out[own, 3 * d] = np.sqrt((mean * mean).sum(axis=1))
            out[own, 3 * d + 1] = share / n
        return out

    def log_odds(self, pooled: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.zeros(len(pooled))
        w1, b1, w2, b2 = self.layers
        return (np.maximum((pooled - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2)[:, 0].astype(np.float64)

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(self.pooled(column)) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = 42):
    """Two-layer network by Adam on the cross-entropy; both labels weigh alike in sum."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, 1)), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            i = order[lo : lo + 256]
            h = np.maximum(x[i] @ p[0] + p[1], 0)
            z = (h @ p[2] + p[3])[:, 0]
            g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i]) * weight[i] / len(i))[:, None]
            back = (g @ p[2].T) * (h > 0)
            t += 1
            for k, step in enumerate((x[i].T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * step
                v[k] = 0.999 * v[k] + 0.001 * step * step
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(a.astype(np.float32) for a in p)


def fit_temperature(log_odds: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden-section search on its logarithm."""

    def loss(log_t: float) -> float:
        z = log_odds / np.exp(log_t)
        return float(np.mean(np.logaddexp(0, -z) * y + np.logaddexp(0, z) * (1 - y)))

    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", *, learn: Column | None = None, shape: Shape = Shape(), max_rows: int = 8000, seed: int = 42) -> Quality:
    """Word vectors of all ``docs``, and a network learned from labelled rows.

    The network is fitted on at most ``max_rows`` labelled documents, those with the
    least hashed key, a fifth of them kept apart for the temperature. Labels of a
    document named several times are averaged; null labels and null doc_ids teach
    nothing. Where only one label, or none, is known, every text scores one half.
    """
    spark = docs.sparkSession
    vectors, count = word_vectors(docs, shape)
    freq = count / max(count.sum(), 1)
    long = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    unit = (vectors / np.maximum(long, 1e-9)).astype(np.float32)
    blank = np.zeros(3 * shape.dim + 2, dtype=np.float32)
    model = Quality(shape, unit, (1e-3 / (1e-3 + freq)).astype(np.float32), blank, blank + 1)
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(F.coalesce(learn if learn is not None else F.lit(True), F.lit(False)))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("_y"))
    # at most max_rows lines of two numbers: small enough to send to every task
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    held = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = held.value.pooled(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_y", "text").mapInArrow(features, "doc_id bigint, y double, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["y"] for r in rows])
    if len(set(y)) < 2:
        return model
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype=np.float32).reshape(len(y), -1)
    apart = np.random.default_rng(seed).random(len(y)) < 0.2
    model.mean, model.scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-3
    norm = (x - model.mean) / model.scale
    model.layers = fit_network(norm[~apart].astype(np.float64), y[~apart], seed=seed)
    if len(set(y[apart])) == 2:
        model.temperature = fit_temperature(model.log_odds(x[apart]), y[apart])
    return model


def with_quality(docs: DataFrame, model: Quality, *, to: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text.

    Null texts count as empty; an empty text gets the score of a pooled vector of zeros.
    A column of the same name is replaced; other columns pass unchanged.
    """
    spark = docs.sparkSession
    ship(spark)
    ensure_short_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            yield pa.array(held.value.score(texts), pa.float64())

    return docs.withColumn(to, F.arrow_udf(score, "double")(F.col("text")))
