"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

A word's vector is the sum of the sparse random index vectors of its neighbours over the whole corpus.
Words fall into BUCKETS by hash, so the model has BUCKETS x DIM numbers whatever the corpus; the shapes of words
(letters by case, digits, marks) have vectors of their own. The counts are whole numbers,
so the sums don't depend on the order of partitions. The network is fitted on the driver with up to TRAIN labelled
rows, and its probabilities are calibrated by a temperature fitted on every fifth of them.

Null and empty texts have a zero vector and are scored from that. Rows that are held out (crc32 of the id
mod 4 is 2) never train. The network is fitted whenever both kinds are among the training rows; without
them every score is the share of label 1, or 0.5, and the model says so (`constant`). Rows that repeat an id all train, with its
highest label, and each gets a score; null ids never train. Other columns than doc_id and text, whatever their names, are kept
and not read. A text must fit in a task; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slabs, table

BUCKETS, DIM, NONZERO, TRAIN, HIDDEN, SEED, ACCEPT = 1 << 14, 64, 4, 20_000, 32, 5, 0.7
# Texts whose words are counted at once.
COUNT_BYTES = 1 << 20
_SHAPE = [(re.compile(p), s) for p, s in ((r"[^\W\d_a-z]*[A-Z]+[^\W\d_a-z]*", "A"), (r"[^\W\d_A]+", "a"), (r"\d+", "0"))]


class _Buckets(dict):
    """A word's bucket, and that of its shape in the upper bits."""

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        s = w
        for p, to in _SHAPE:
            s = p.sub(to, s)
        b = xxhash.xxh64_intdigest(w) % BUCKETS | (xxhash.xxh64_intdigest(s, 1) % BUCKETS) << 32
        self[w] = b
        return b


def _streams(text: str | None, buckets: _Buckets) -> list[np.ndarray]:
    ws = text.split() if text else []
    both = np.fromiter(map(buckets.__getitem__, ws), np.int64, len(ws))
    return [both & 0xFFFFFFFF, both >> 32]


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1, 1], (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """2 x BUCKETS x DIM unit vectors, of words and of shapes."""
    parts = docs.rdd.getNumPartitions()
    salts = max(1, int(parts**0.5))

    def count(batches):
        at, sign = _index_vectors()
        total, buckets, any_text = np.zeros((2, BUCKETS * DIM)), _Buckets(), False
        for b in slabs(batches, size=COUNT_BYTES):
            any_text = True
            docs = [_streams(t, buckets) for t in b["text"].to_pylist()]
            for k in range(2):
                # A gap parts documents, so neighbours are of one text.
                flat = np.concatenate([x for d in docs for x in (d[k], [-1])])
                a, c = flat[:-1], flat[1:]
                ok = (a >= 0) & (c >= 0)
                for x, y in ((a[ok], c[ok]), (c[ok], a[ok])):
                    total[k] += np.bincount((x[:, None] * DIM + at[y]).ravel(), sign[y].ravel(), BUCKETS * DIM)
        if any_text:
            chunks = total.astype(np.int64).reshape(64, -1)
            from pyspark import TaskContext

            salt = TaskContext.get().partitionId() % salts
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([salt] * 64, pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], ["chunk", "salt", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf.sums)
        return pd.DataFrame({"chunk": pdf.chunk[:1], "salt": pdf.salt[:1], "sums": [total.tobytes()]})

    schema = "chunk int, salt int, sums binary"
    sums = mapped(docs.select("text"), count, schema).groupBy("chunk", "salt").applyInPandas(add, schema)
    got = sums.groupBy("chunk").applyInPandas(add, schema).collect()  # 64 rows, 2 * BUCKETS * DIM numbers
    if not got:
        return np.zeros((2, BUCKETS, DIM), np.float32)
    v = np.concatenate([np.frombuffer(r["sums"], np.int64) for r in sorted(got, key=lambda r: r["chunk"])]).reshape(2, BUCKETS, DIM).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=2, keepdims=True), 1e-9)


def pool(text: str | None, vectors: np.ndarray, buckets: _Buckets) -> np.ndarray:
    streams = _streams(text, buckets)
    n = len(streams[0])
    out = np.zeros(2 * DIM + 2, np.float32)
    if n:
        for k, s in enumerate(streams):
            which, times = np.unique(s, return_counts=True)
            out[k * DIM : (k + 1) * DIM] = times.astype(np.float32) @ vectors[k][which] / n
            out[2 * DIM + k] = len(which) / n
    return out


class Network:
    """tanh layer and logistic output, fitted by Adam; probabilities at a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60) -> None:
        self.rate = float(y.mean()) if len(y) else 0.5
        self.constant = len(set(y.tolist())) < 2
        if self.constant:
            return
        rng = np.random.default_rng(SEED)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.std
        fold = np.arange(len(x)) % 5 == 4
        # Few rows calibrate nothing, and both kinds have to train.
        if not fold.any() or len(set(y[~fold].tolist())) < 2:
            fold[:] = False
        tx, ty = x[~fold], y[~fold]
        p = self.p = [rng.standard_normal((x.shape[1], HIDDEN)) / x.shape[1] ** 0.5, np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / HIDDEN**0.5, np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(tx))
            for at in range(0, len(order), 128):
                a, b = tx[order[at : at + 128]], ty[order[at : at + 128]]
                h = np.tanh(a @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - b) / len(b)
                dh = d[:, None] * p[2] * (1 - h * h)
                grads = [a.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d, d.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if not fold.any():
            return
        z = self._logit(x[fold])
        loss = lambda k: np.logaddexp(0, np.where(y[fold] > 0, -z, z) / k).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 100), key=loss))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-self._logit((x - self.mean) / self.std) / self.temperature))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    docs = docs.select("doc_id", "text")
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN)

    def pooled(batches):
        buckets = _Buckets()
        for b in slabs(batches, size=COUNT_BYTES):
            x = [pool(t, shared.value, buckets).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["quality"], pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")), "doc_id")
    rows = mapped(rows.select("doc_id", "quality", "text"), pooled, "doc_id long, quality int, x binary").orderBy("doc_id", "x").limit(TRAIN).collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], float) if rows else np.zeros((0, 2 * DIM + 2))
    return vectors, Network(x, np.array([r["quality"] for r in rows], float))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], column: str = "score") -> DataFrame:
    """The documents with a column score, which takes the place of one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)

    def run(batches):
        buckets = _Buckets()
        for b in slabs(batches, size=COUNT_BYTES):
            vectors, network = shared.value
            s = network.score(np.array([pool(t, vectors, buckets) for t in b["text"].to_pylist()], float))
            yield b.append_column(column, pa.array(s, pa.float64()))

    from pyspark.sql.types import DoubleType, StructType

    return mapped(docs, run, StructType([*docs.schema.fields]).add(column, DoubleType()))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
