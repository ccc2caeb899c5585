"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLAB_BYTES = 4_000_000
# Texts whose words are hashed at once.
HASH_BYTES = 1 << 18
# Bytes of an Arrow batch on its way to Python; Spark's own limit is eight times as much.
BATCH_BYTES = 8 << 20
# A key that has more than 1 / HOT of all rows is hot, so there are fewer than HOT of them.
HOT = 1000
# A sieve has 2^SIEVE_BITS bits in buckets of 2^15, so it takes 4 MB at most.
SIEVE_BITS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Unset, a temporary one is set where driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="ckpt")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder, so a lost executor loses nothing. The table goes when
    it is released or else when the driver ends."""
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(name)
    path, fs = _path(spark, name)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(name)
    out.written_ = name
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete durable tables that nothing reads any more."""
    for t in tables:
        if name := getattr(t, "written_", None):
            path, fs = _path(t.sparkSession, name)
            fs.delete(path, True)


def mapped(df: DataFrame, f: Callable, schema) -> DataFrame:
    """mapInArrow in batches of BATCH_BYTES; a task gives the memory that it freed back to the system."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d+", df.sparkSession.conf.get(key))[0]) != BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(run, schema)


def slabs(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about size bytes of text (or one longer row)."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal keys, from batches that are sorted by them."""
    held = None
    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        new = np.zeros(len(t) - 1, bool)
        for k in keys:
            new |= np.diff(t[k].to_numpy()) != 0
        cut = int(new.nonzero()[0][-1]) + 1 if new.any() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and len(held):
        yield held


def attach(rows: DataFrame, values: DataFrame, key: str | list[str], total: int, written: bool = False) -> DataFrame:
    """Rows joined with values, which has one row a key and in column n how many of the total rows have it.

    Values of hot keys, fewer than HOT, are broadcast, so their rows aren't gathered into one task. If values is a
    written table with one key that is never null, its hot keys are read first and only rows that have them meet the broadcast."""
    hot = F.col("n") * HOT > F.lit(total)
    keys = [key] if isinstance(key, str) else key
    often, seldom = values.where(hot).drop("n"), values.where(~hot).drop("n")
    if written:
        found = [r[0] for r in often.select(*keys).collect()]  # fewer than HOT
        if not found:
            return rows.join(seldom, keys)
        among = F.col(keys[0]).isin(found)
        return rows.where(among).join(F.broadcast(often), keys).unionByName(rows.where(~among).join(seldom, keys))
    near = rows.join(F.broadcast(often), keys)
    far = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(seldom, keys)
    return near.unionByName(far)


def sieve(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that may have one of the keys, and rows that surely have none; none is moved.

    A bitmap of key hashes, of a fixed size, is broadcast. Only the rows of the first part need a join."""
    place = F.pmod(F.xxhash64(*on), F.lit(1 << SIEVE_BITS))
    bits = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits_"))
    marked = rows.withColumn("p_", place).withColumn("bucket_", F.bitmap_bucket_number("p_")).join(F.broadcast(bits), "bucket_", "left")
    at = F.bitmap_bit_position(F.col("p_"))
    byte = F.conv(F.hex(F.substring("bits_", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("bits_ is not null") & (F.shiftrightunsigned(byte, 0).bitwiseAND(F.pow(F.lit(2), (at % 8)).cast("int")) != 0), F.lit(False))
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(v, root): the smallest id reachable over edges (a, b); vertices without an edge are absent.

    Alternating large-star and small-star rounds, until all edges lead from a vertex to its root; or so many rounds, after
    which a root is only some smaller vertex that is reachable. Minima are aggregates joined back, and those of
    hubs are broadcast, so a vertex of high degree is never gathered into one task. Every round is written."""
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = e.count()
    while rounds is None or rounds > 0:
        roots = e.select("v").distinct()
        if e.select("u").distinct().count() == n and e.select(F.col("u").alias("v")).join(roots, "v", "left_semi").isEmpty():
            break
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        large = durable(attach(both.where("v > u"), low, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = attach(large, low, "u", 2 * n).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        last, e = e, durable(small.select("e.*").where("u <> v").distinct())
        release(last, large)
        n = e.count()
        rounds = rounds and rounds - 1
    out = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("root"))
    out.written_ = e.written_
    return out


_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(17).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse, modulo 2^64."""
    held = _POWERS.get(which)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        ups = [np.full(size, x, np.uint64) for x in (_ODD[which], pow(_ODD[which], -1, 1 << 64))]
        for u in ups:
            u[0] = 1
        held = tuple(np.cumprod(u, dtype=np.uint64) for u in ups)
        # Those for one long text aren't kept.
        if size <= 4 * HASH_BYTES:
            _POWERS[which] = held
    return held


def word_hashes(texts: pa.Array, space: np.ndarray, fold: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and where each text's words begin (one more than texts).

    Words are the longest runs of bytes for which space (by byte) is false; fold gives the byte that stands for a byte. The hash is
    a polynomial of the bytes, taken from running sums; which chooses one of two."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    x = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = (at - at[0]).astype(np.int64)
    inside = ~space[x]
    row = np.zeros(len(x) + 1, bool)
    row[at] = True
    before = np.concatenate([[False], inside[:-1]]) & ~row[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~row[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    h = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        # Words of about HASH_BYTES at once (or one longer word); where a word stands doesn't change its hash.
        j = max(i + 1, int(np.searchsorted(end, start[i] + HASH_BYTES, "right")))
        y, s, e = x[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i]
        up, down = _powers(len(y) + 1, which)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[which][fold[y]] * up[: len(y)], dtype=np.uint64)])
        h[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29)), np.searchsorted(start, at)
