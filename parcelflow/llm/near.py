"""MinHash near-dedup with sequential Bayesian verification.

Documents with the same words in the same order (by a 128-bit digest) form a class; one row of each goes on. Bands of the
signature retrieve candidates; a pair's signatures are compared in batches, and it is dropped once the posterior
chance that its similarity reaches the threshold is below MISS; survivors are verified on full sets.

Candidates come in rounds. The members of a bucket meet one leader of it, which joins most of a large group; in buckets that
then still hold parts not known to be connected, another leader, until few pairs are left or a round spares less than half of
them (LED rounds at most). Then members of
different parts meet each other: in buckets of up to SMALL members their plausible pairs go on; in larger ones, cut into blocks, plausible
pairs meet on full sets of 64-bit shingle hashes in the block, and of those that link two parts anew one goes on. So a group of
thousands of copies gives links in proportion to its size, and every link is confirmed on full sets of shingles.

Null, empty and blank texts have an empty set and link with nothing. A row without a doc_id links with nothing either: its
component is null, and it is kept. Rows that repeat a doc_id are one document of that id, linked by each of its
texts, and each gets its row. Only doc_id and text are read, whatever other columns are named. A text must fit in a
task; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_BYTES, attach, components, durable, mapped, release, runs, sieve, slabs, table, word_hashes

BANDS, ROWS, BATCH, MISS, SEED, LED, BLOCK = 32, 4, 16, 1e-6, 11, 4, 4096
# Members of a bucket up to which it gives all plausible pairs; shingle hashes of a block of a larger one.
SMALL, BLOCK_HASHES = 256, 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FOLD, SPACE = np.frombuffer(_FOLD, np.uint8), np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# Sum of pairs in mixed buckets, for each class, up to which all of them are compared at once: about what a round costs.
EASY = 100
# The share of the pairs before a round that, left after it, makes it the last.
STALE = 0.5


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def shingles(text: str | None, n: int) -> set[bytes]:
    ws = words(text)
    if not ws:
        return set()
    if len(ws) < n:
        return {b" ".join(ws)}
    return set(map(b" ".join, zip(*(ws[k:] for k in range(n)), strict=False)))


def _shingle_hashes(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted."""
    h, at = word_hashes(texts, SPACE, FOLD)
    out = []
    for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        size, k = max(1, y - x - n + 1), min(n, y - x)
        code = np.full(size if k else 0, k, np.uint64)
        for j in range(k):
            code = (code ^ h[x + j : x + j + size]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        code.sort()
        out.append(code[np.concatenate([[True], code[1:] != code[:-1]])[: len(code)]])
    return out


def signature(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The lower halves of the 32-bit minima; two different ones agree with chance 2^-16."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(seeds), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        out = np.minimum(out, ((x[at : at + 4096, None] ^ seeds[None, :, 0]) * seeds[None, :, 1]).min(0))
    return out.astype(np.uint16)


def bounds(total: int, batch: int, threshold: float, miss: float) -> list[int]:
    """Least number of equal values after each batch for which P(similarity >= threshold) >= miss, under a uniform prior."""
    grid = np.linspace(0.0005, 0.9995, 1000)
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() >= miss:
                break
        out.append(m)
    return out


def _plausible(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        s = slice(k * BATCH, (k + 1) * BATCH)
        equal[alive] += (a[alive, s] == b[alive, s]).sum(1)
        alive = alive[equal[alive] >= m]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, mark (of the text), n_shingles, whole (digest of the words), sig: one row per document."""
    seeds = np.random.default_rng(SEED).integers(0, 1 << 32, (BANDS * ROWS, 2), dtype=np.uint32) | np.uint32(1)

    def sign(batches):
        for b in slabs(batches, size=HASH_BYTES):
            sizes, whole, sigs = [], [], []
            for t, h in zip(b["text"].to_pylist(), _shingle_hashes(b["text"], n), strict=True):
                ws = words(t)
                sizes.append(len(h))
                whole.append(hashlib.blake2b(b" ".join(ws), digest_size=16).digest() if ws else None)
                sigs.append(signature(h, seeds).tobytes() if ws else None)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["mark"], pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "mark", "n_shingles", "whole", "sig"])

    return mapped(docs, sign, "doc_id long, mark long, n_shingles long, whole binary, sig binary")


def _by_signature(pairs: DataFrame, classes: DataFrame, least: list[int]) -> DataFrame:
    """The pairs (a, b) whose signatures leave them plausible; block: a part of at most about BLOCK of the pairs that share b."""

    def keep(batches):
        for b in batches:
            if len(b):
                at = pa.array(np.flatnonzero(_plausible(_matrix(b["sa"]), _matrix(b["sb"]), least)))
                yield pa.RecordBatch.from_arrays([b[c].take(at) for c in ("a", "b", "block")], ["a", "b", "block"])

    many = pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    heads = many.join(classes.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
    both = attach(pairs, heads, "b", pairs.count()).join(classes.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a")
    return mapped(both.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks"))), keep, "a long, b long, block long")


def _texts(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cid, text of the classes in ids. No other texts are moved but for a few that the sieve lets through."""
    wanted = durable(classes.select("cid", "doc_id", "mark").join(ids, "cid"))
    maybe, _ = sieve(docs, wanted, ["doc_id", "mark"])
    # Rows that repeat a document give one text.
    out = durable(maybe.join(wanted, ["doc_id", "mark"]).groupBy("cid").agg(F.first("text").alias("text")))
    release(wanted)
    return out


def _verified(placed: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b, block) whose full shingle sets reach the threshold. Only the texts of pairs are moved: each to the blocks
    of its pairs; there the text of b comes first and is cut once."""
    texts = _texts(placed.select(F.col("a").alias("cid")).union(placed.select("b")).distinct(), classes, docs)
    members = placed.join(texts.withColumnRenamed("cid", "a"), "a").select("b", "block", "a", "text")
    heads = placed.select("b", "block").distinct().join(texts.withColumnRenamed("cid", "b"), "b").select("b", "block", F.lit(None).cast("long").alias("a"), "text")

    def exact(batches):
        of, held = None, set()
        for x in batches:
            a, b = [], []
            for bid, block, aid, t in zip(*(x[c].to_pylist() for c in ("b", "block", "a", "text")), strict=True):
                s = shingles(t, n)
                if aid is None:
                    of, held = (bid, block), s
                    continue
                assert of == (bid, block)
                both = len(s & held)
                if 100 * both >= percent * (len(s) + len(held) - both):
                    a.append(aid)
                    b.append(bid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = members.unionByName(heads).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())
    out = durable(mapped(rows, exact, "a long, b long"))
    release(texts)
    return out


def _within(buckets: DataFrame, least: list[int]) -> DataFrame:
    """Plausible pairs (a, b) of different components within small buckets (band, cid, root, sig, at); block is 0.

    A pair counts in its first common band only."""

    def pairs(batches):
        for b in runs(batches, ["band"]):
            band, cid, root, at = (b[c].to_numpy() for c in ("band", "cid", "root", "at"))
            sig = _matrix(b["sig"])
            bands = np.ascontiguousarray(sig).view(np.uint64)
            run = np.cumsum(np.concatenate([[True], np.diff(band) != 0]))
            k, step = np.arange(len(run) - 1), 1
            while len(k):
                k = k[k + step < len(run)]
                k = k[run[k + step] == run[k]]
                p = k[root[k] != root[k + step]]
                for cut in range(0, len(p), 50_000):
                    p_, q = p[cut : cut + 50_000], p[cut : cut + 50_000] + step
                    # argmax: the first band in which both agree.
                    first = (bands[p_] == bands[q]).argmax(1) == at[p_]
                    p_, q = p_[first], q[first]
                    good = _plausible(sig[p_], sig[q], least)
                    if good.any():
                        a, c = cid[p_[good]], cid[q[good]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, c)), pa.array(np.minimum(a, c)), pa.array(np.zeros(len(a), np.int64))], ["a", "b", "block"])
                step += 1

    return mapped(buckets.select("band", "cid", "root", "sig", "at").repartition("band").sortWithinPartitions("band"), pairs, "a long, b long, block long")


def _forest(buckets: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, least: list[int]) -> DataFrame:
    """Pairs (a, b) that connect the components within large buckets (band, cid, root, at, n); block is 0.

    A bucket is cut into blocks of about BLOCK rows and BLOCK_HASHES shingle hashes, compared two by two, where a pair counts in
    its first common band only. Plausible pairs are compared on full sets of hashes, and a block gives only links that
    connect parts it hasn't connected, so fewer than it has rows."""

    def hashed(batches):
        for b in slabs(batches, size=HASH_BYTES):
            yield pa.RecordBatch.from_arrays([b["cid"], pa.array([h.tobytes() for h in _shingle_hashes(b["text"], n)], pa.binary())], ["cid", "hashes"])

    texts = _texts(buckets.select("cid").distinct(), classes, docs)
    sets = durable(mapped(texts, hashed, "cid long, hashes binary"))
    release(texts)
    sized = buckets.drop("n").join(classes.select("cid", "sig", "n_shingles"), "cid")
    weights = durable(sized.groupBy("band").agg(F.sum("n_shingles").alias("hashes"), F.count("*").alias("n")))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("hashes") / BLOCK_HASHES)).alias("blocks")
    x = attach(sized, weights.select("band", blocks, "n"), "band", sized.count(), written=True).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    x = x.join(sets, "cid").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    x = x.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "root", "sig", "at", "hashes")

    def links(batches):
        for b in runs(batches, ["band", "i", "j"]):
            own, cid, label, at = (b[c].to_numpy() for c in ("own", "cid", "root", "at"))
            within, label, sig = b["i"][0] == b["j"][0], label.copy(), _matrix(b["sig"])
            bands = np.ascontiguousarray(sig).view(np.uint64)
            held = b["hashes"].to_pylist()
            size = np.array([len(h) // 8 for h in held])
            end = np.cumsum(size)
            # Hashes by rank, so a set can be marked in an array.
            rank = np.unique(np.frombuffer(b"".join(held), np.uint64), return_inverse=True)[1]
            mark = np.zeros(len(rank), bool)
            own_set = [rank[e - k : e] for e, k in zip(end.tolist(), size.tolist(), strict=True)]
            a, c = [], []
            for p in range(1, len(cid)):
                q = np.flatnonzero((label[:p] != label[p]) & (within | (own[:p] != own[p])))
                # argmax: the first band in which both agree.
                q = q[(bands[q] == bands[p]).argmax(1) == at[p]]
                q = q[_plausible(sig[q], np.broadcast_to(sig[p], (len(q), sig.shape[1])), least)]
                if not len(q):
                    continue
                mark[own_set[p]] = True
                both = np.add.reduceat(mark[np.concatenate([own_set[k] for k in q])], np.cumsum(size[q]) - size[q], dtype=np.int64)
                mark[own_set[p]] = False
                q = q[100 * both >= percent * (size[q] + size[p] - both)]
                parts, one = np.unique(label[q], return_index=True)
                a.extend(np.maximum(cid[q[one]], cid[p]))
                c.extend(np.minimum(cid[q[one]], cid[p]))
                label[np.isin(label, parts)] = label[p]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(np.zeros(len(a), np.int64))], ["a", "b", "block"])

    out = durable(mapped(x.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j"), links, "a long, b long, block long").distinct())
    release(sets, weights)
    return out


def link(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents whose word n-gram sets have a Jaccard similarity of percent or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("mark", F.xxhash64("text"))
    least = bounds(BANDS * ROWS, BATCH, percent / 100, MISS)
    signed = durable(_signed(docs, n))
    found = signed.where("whole is not null and doc_id is not null")
    one = F.min(F.struct("doc_id", "mark")).alias("one")
    classes = found.groupBy("whole").agg(one, F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    classes = durable(classes.select(F.monotonically_increasing_id().alias("cid"), "whole", "one.*", "sig", "n_shingles", "n"))
    total = found.count()
    copies = attach(found.select("whole", F.col("doc_id").alias("a")), classes.where("n > 1").select("whole", F.col("doc_id").alias("b"), "n"), "whole", total).select("a", "b")

    width = 2 * ROWS
    band = lambda k: F.xxhash64(k, F.substring("sig", k * width + 1, F.lit(width)))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(band(k).alias("band"), k.alias("at")))
    buckets = classes.select("cid", F.explode(bands).alias("x")).select("x.*", "cid")
    count = classes.count()
    leads = durable(buckets.groupBy("band").agg(F.min("cid").alias("lead"), F.count("*").alias("n"), F.count("*").alias("rows")).where("n > 1"))
    members = durable(attach(buckets, leads, "band", count * BANDS, written=True))
    release(leads)
    pairs_left = F.sum((F.col("rows") - 1) / 2)
    (size, last), edges = members.agg(F.count("*"), pairs_left).first(), []
    for k in range(LED):
        if not size:
            break
        pairs = durable(members.where("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")).distinct())
        plausible = durable(_by_signature(pairs, classes, least))
        edges.append(_verified(plausible, classes, docs, n, percent))
        release(pairs, plausible)
        # Leaders have met all others of their buckets. What isn't known yet to be connected may only meet again.
        left = members.where("cid <> lead").drop("root", "rows")
        near = edges[0]
        for e in edges[1:]:
            near = near.union(e)
        root = near.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "cid")
        left = left.join(root, "cid", "left").withColumn("root", F.least("cid", "root"))
        mixed = left.groupBy("band").agg(F.min("root").alias("low"), F.max(F.struct("root", "cid")).alias("high"), F.count("*").alias("n")).where("low <> high.root")
        mixed = durable(mixed.select("band", F.col("high.cid").alias("lead"), "n", F.col("n").alias("rows")))
        met = durable(attach(left.drop("lead"), mixed, "band", size, written=True))
        release(members, mixed)
        members = met
        size, work = met.agg(F.count("*"), pairs_left).first()
        # Members that are unlike each other stay apart whoever leads them: a round that spares less than half is the last.
        if work is None or work <= EASY * count or work > STALE * last:
            break
        last = work
    if size:
        few, many = members.where(F.col("rows") <= SMALL), members.where(F.col("rows") > SMALL).withColumnRenamed("rows", "n")
        plausible = [durable(_within(few.join(classes.select("cid", "sig"), "cid"), least))]
        if not many.isEmpty():
            plausible.append(_forest(many, classes, docs, n, percent, least))
        edges.append(_verified(functools.reduce(DataFrame.union, plausible), classes, docs, n, percent))
        release(*plausible)
    release(members)
    every = copies.where("a <> b")
    ids = classes.select("cid", "doc_id")
    for e in edges:
        e = e.join(ids.toDF("a", "da"), "a").join(ids.toDF("b", "db"), "b")
        every = every.union(e.select("da", "db"))
    roots = components(every)
    release(classes, *edges)
    out = signed.select("doc_id", "n_shingles").join(roots, signed.doc_id == F.col("v"), "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op10_near(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), 4)
