"""Document quality from random-indexing word vectors and a two-layer network, with calibrated probabilities.

Each word has an index vector: sparse random signs for the word, its shape, its beginning and its end, drawn from a fixed
table by hash, so no word is unknown. Its context vector is the sum of the index vectors of the words around it, over all
documents, in a table of hashed words of fixed size. The word's vector is the sum of both, each of length one. A
document is pooled over all its words: the mean vector, the mean product of neighbours (which repetition raises) and its
length. A network of one hidden layer learns from that in numpy on the driver, and a temperature, fitted on training
documents that the network did not learn from, makes its outputs probabilities.

Word contexts are sums of whole numbers over every document, labelled or not; tasks sum by hashed word before they are
added up. The network and the temperature take at most ``MAX_TRAIN`` labelled documents, those with the smallest hashes of
their key. What reaches the driver is of fixed size: one table of contexts, and a pooled vector for each training document.
All documents are scored, each by its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from .common import as_bytes, table, written

#: Labelled documents that a fit takes at most, and tasks that read them.
MAX_TRAIN, FIT_TASKS = 20_000, 8
#: Length of word vectors, hashed words with contexts of their own, index vectors, and words to each side of a context.
SIZE, BUCKETS, INDEX, AROUND = 32, 1 << 14, 1 << 16, 2
#: Words of a text of which contexts are summed at once.
PIECE = 1 << 16
#: Different words that a worker keeps vectors of before it starts anew.
CACHE_WORDS = 200_000
#: Score from which a document counts as good.
THRESHOLD = 0.7

_SHAPE = bytes(ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b if b < 0x80 and not 97 <= b <= 122 else ord("a") for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def _index_table() -> np.ndarray:
    """Four signs in each row, the same in every process."""
    rng = np.random.Generator(np.random.PCG64(8))
    out = np.zeros((INDEX, SIZE), np.float32)
    for _ in range(4):
        out[np.arange(INDEX), rng.integers(0, SIZE, INDEX)] += rng.choice(np.float32([-1, 1]), INDEX)
    return out


class Words:
    """Vectors of words: index vectors, with contexts added if there are any."""

    def __init__(self, contexts: np.ndarray | None = None):
        self.signs, self.contexts = _index_table(), contexts
        self.reset()

    def reset(self) -> None:
        self.row: dict[bytes, int] = {}
        self.parts: tuple[dict[bytes, int], ...] = ({}, {}, {})  # hashes of shapes, beginnings and ends
        self.vectors = np.zeros((4096, SIZE), np.float32)
        self.bucket = np.zeros(4096, np.int32)

    def _part(self, k: int, x: bytes) -> int:
        known = self.parts[k].get(x)
        if known is None:
            known = self.parts[k][x] = xxhash.xxh64_intdigest(x if k else _RUN.sub(rb"\1", x), k + 1) % INDEX
        return known

    def _add(self, words: list[bytes]) -> None:
        n, to = len(self.row), len(self.row) + len(words)
        while to > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.bucket = np.concatenate([self.bucket, np.zeros_like(self.bucket)])
        own = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        part = self._part
        picked = np.array([(part(0, w.translate(_SHAPE)), part(1, w[:2]), part(2, w[-3:])) for w in words])
        vectors = self.signs[(own % INDEX).astype(np.int64)] + 2 * self.signs[picked[:, 0]] + self.signs[picked[:, 1]] + self.signs[picked[:, 2]]
        self.bucket[n:to] = own % BUCKETS
        if self.contexts is not None:
            vectors = vectors / np.maximum(1e-6, np.sqrt((vectors * vectors).sum(1, keepdims=True))) + self.contexts[self.bucket[n:to]]
        self.vectors[n:to] = vectors
        self.row.update(zip(words, range(n, to), strict=True))

    def rows(self, text: bytes) -> np.ndarray:
        """Row of each word of a text. Rows of earlier texts may change."""
        if len(self.row) > CACHE_WORDS:
            self.reset()
        words = text.split()
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if new:
            self._add(new)
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def pooled(self, text: bytes) -> np.ndarray:
        rows = self.rows(text)
        out = np.zeros(2 * SIZE + 1, np.float32)
        for a in range(0, len(rows), 1 << 16):
            v = self.vectors[rows[a : a + (1 << 16) + 1]]
            out[:SIZE] += v[: 1 << 16].sum(0)
            out[SIZE:-1] += (v[:-1] * v[1:]).sum(0)
        out[:-1] /= max(1, len(rows))
        out[-1] = np.log1p(len(rows)) / 10
        return out

    def around(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """For each word the sum of the vectors of the words around it in its text; of: the text of each word."""
        v = self.vectors[rows]
        out = np.zeros_like(v)
        for d in range(1, AROUND + 1):
            out[:-d] += v[d:]
            out[d:] += v[:-d]
            apart = np.flatnonzero(of[:-d] != of[d:])
            out[apart] -= v[apart + d]
            out[apart + d] -= v[apart]
        return out


@dataclass
class Model:
    contexts: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(_standard(x, self.mean, self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -4, 4)


def train(x: np.ndarray, y: np.ndarray, contexts: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 1) -> Model:
    """Fits the network on nine tenths of the rows and the temperature on the rest. Rows must come in a settled order."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x, y = x.astype(np.float64), y.astype(np.float64)
    if not len(x):
        x, y = np.zeros((1, 2 * SIZE + 1)), np.ones(1)  # nothing is known: all are alike
    kept = np.arange(len(x)) % 10 == 0
    learn = ~kept if (~kept).any() else kept
    mean, scale = x[learn].mean(0), x[learn].std(0) + 1e-3
    m = Model(contexts, mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0, 1.0)
    p = [m.w1, m.b1, m.w2, np.array([m.b2])]
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in p]
    z, t = _standard(x[learn], mean, scale), y[learn]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            step += 1
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60)))
            d = (out - t[rows]) / len(rows)
            dh = np.outer(d, p[2]) * (h > 0)
            grads = [z[rows].T @ dh + 1e-3 * p[0], dh.sum(0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
            for a, g, (m1, m2) in zip(p, grads, moments, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                a -= 0.003 * m1 / (1 - 0.9**step) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = p[0], p[1], p[2], float(p[3][0])
    logits, truth = m.logits(x[kept]), y[kept]
    loss = lambda c: float(np.mean(np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / c)))
    m.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return m


def held_out(df_key) -> F.Column:
    """Rows that no fit learns from: the CRC-32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(df_key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def contexts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each bucket of hashed words the sum of the index vectors around its words in all documents, of length one.

    The sums are of whole numbers, so they are the same however documents are dealt to tasks."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums, held = Words(), np.zeros((BUCKETS, SIZE), np.int64), []

        def flush() -> None:
            at, of = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
            held.clear()
            for a in range(0, len(at), PIECE):  # with the words around a piece of a long text
                low, high = max(0, a - AROUND), min(len(at), a + PIECE + AROUND)
                around = words.around(at[low:high], of[low:high])[a - low : a - low + PIECE]
                bucket = words.bucket[at[a : a + PIECE]]
                order = np.argsort(bucket, kind="stable")
                first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                sums[bucket[order][first]] += np.add.reduceat(around[order], first, axis=0).astype(np.int64)

        n = 0
        for batch in batches:
            for text in batch.column(0):
                if held and (n >= PIECE or len(words.row) > CACHE_WORDS):  # rows change when the cache starts anew
                    flush()
                    n = 0
                held.append(words.rows(text.as_py()))
                n += len(held[-1])
        if held:
            flush()
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in sums[some].T)], names=["bucket", *columns])

    columns = [f"s{k}" for k in range(SIZE)]
    parts = docs.select(as_bytes(F.col(text)).alias("text")).mapInArrow(summed, f"bucket int, {', '.join(f'{c} long' for c in columns)}")
    total = np.zeros((BUCKETS, SIZE))
    for r in parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).collect():  # at most BUCKETS rows
        total[r[0]] = r[1:]
    return (total / np.maximum(1e-6, np.sqrt((total * total).sum(1, keepdims=True)))).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Learns labels from rows that are not held out, and word contexts from all. Rows with a null key or label are ignored; of several labels of one
    key the smallest holds. Without any labelled row, all scores are alike."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    sample = known.orderBy(F.xxhash64("k"), "k").limit(max_train)  # at most max_train short rows: small enough to broadcast
    rows = docs.select(F.col(key).alias("k"), as_bytes(F.col(text)).alias("text")).join(F.broadcast(sample), "k")
    rows = written(rows.repartition(FIT_TASKS, "k").sortWithinPartitions("k", "text"), "training")

    table_ = contexts(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(table_)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in batches:
            x = [words.pooled(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32())), batch.column(2)], names=["k", "x", "y"])

    schema = StructType([rows.schema["k"]]).add("x", ArrayType(FloatType())).add("y", "integer")
    got = rows.select("k", "text", F.col("y").cast("int").alias("y")).mapInArrow(pool, schema).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(-1, 2 * SIZE + 1)
    order = np.lexsort((*x.T[:4], np.array([xxhash.xxh64_intdigest(str(k).encode()) for k in got.column("k").to_pylist()], np.uint64)))
    return train(x[order], got.column("y").to_numpy()[order], table_)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs but the text, with score and predicted behind them (they replace columns of those names).

    Only the text enters a score; null text counts as empty and gets the score of no words. No shuffle."""
    docs = docs.drop("score", "predicted")
    rest = [f for f in docs.schema if f.name != text]
    schema = StructType(list(rest)).add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.contexts)
        for batch in batches:
            x = np.array([words.pooled(t.as_py()) for t in batch.column(0)], np.float64).reshape(-1, 2 * SIZE + 1)
            p = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(as_bytes(F.col(text)).alias("text"), *(F.col(f"`{f.name}`") for f in rest)).mapInArrow(score, schema)


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold. No shuffle."""
    schema, at = docs.schema, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.contexts)
        for batch in batches:
            x = np.array([words.pooled((t.as_py() or "").encode()) for t in batch.column(at)], np.float64).reshape(-1, 2 * SIZE + 1)
            yield batch.filter(pa.array(shared.value.scores(x) >= threshold))

    return docs.mapInArrow(keep, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
