"""Embedding near-dedup with a forest of random-projection trees.

Trees are fitted on a bounded sample (SAMPLE vectors); every vector is routed through all of them, to both sides of a split when
it lies within SPILL of it. Where the sample is too small to split further, a tree goes on by random directions that all its
nodes of a level share, cut at the sample's median, until a leaf is expected to hold LEAF vectors; so the model stays bounded
and leaves stay small whatever the number of vectors. Equal vectors are one class, of which one row goes on. Leaves are
compared by blocks of at most about BLOCK rows, so a dense leaf becomes many tasks. A linked pair counts only in the first leaf
that its vectors share, which each row knows from its list of leaves; so leaves return counts and spanning edges, never pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing and keep themselves. Vectors of
different lengths don't link. Rows that repeat an id are one vector of that id: a repeated vector counts once, n_links sums over different ones,
the component holds what any of them links, and each row is returned. A row without an id links with nothing: its component is null, and it is
kept. Only vec_id and embedding are read, whatever other columns are named; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, durable, mapped, release, runs, table

COSINE, TREES, LEAF, SPILL, SAMPLE, BLOCK, SEED = 0.95, 6, 400, 0.0125, 20_000, 8_192, 7
# Leaves of several blocks that are broadcast, at most.
FEW = 100_000


def _units(raw: pa.Array) -> list[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """For each length: places of the vectors that have a direction, their unit vectors, and the bytes as they came."""
    sizes = raw.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = raw.flatten()
    kind = flat.type.to_pandas_dtype()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        x = np.asarray(values[at[rows][:, None] + np.arange(n)], kind)
        d = x.astype(np.float64)
        ok = np.isfinite(d).all(1) & d.any(1)
        rows, d, x = rows[ok], d[ok], x[ok]
        d /= np.abs(d).max(1, keepdims=True)
        out.append((rows, d / np.linalg.norm(d, axis=1, keepdims=True), [v.tobytes() for v in x + kind(0)]))  # + 0: no -0
    return out


class Tree:
    """Splits at the median along random directions, while a node has so many rows of the sample; then levels that share one."""

    def __init__(self, x: np.ndarray, least: float, rng: np.random.Generator) -> None:
        self.nodes: list = []
        self._grow(x, max(least, 2), rng)
        levels = int(np.ceil(np.log2(max(1.0, 2 / least))))
        self.deep = []
        for _ in range(levels):
            way = self._way(x.shape[1], rng)
            self.deep.append((way, float(np.median(x @ way))))

    def _way(self, n, rng):
        way = rng.standard_normal(n)
        return way / np.linalg.norm(way)

    def _grow(self, x, least, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if len(x) > least:
            way = self._way(x.shape[1], rng)
            p = x @ way
            cut = float(np.median(p))
            if (p < cut - SPILL).any() and (p > cut + SPILL).any():
                self.nodes[at] = [way, cut, self._grow(x[p < cut], least, rng), self._grow(x[p >= cut], least, rng)]
        return at

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        todo = [(0, -1, 0, np.arange(len(x)))]
        while todo:
            node, level, bits, rows = todo.pop()
            if not len(rows):
                continue
            if level < 0 and self.nodes[node] is not None:
                way, cut, low, high = self.nodes[node]
                p = x[rows] @ way
                todo += [(low, -1, 0, rows[p < cut + SPILL]), (high, -1, 0, rows[p >= cut - SPILL])]
                continue
            level = max(level, 0)
            if level == len(self.deep):
                yield node << level | bits, rows
                continue
            way, cut = self.deep[level]
            p = x[rows] @ way
            todo += [(node, level + 1, bits << 1, rows[p < cut + SPILL]), (node, level + 1, bits << 1 | 1, rows[p >= cut - SPILL])]


def _linked(xa: np.ndarray, xb: np.ndarray, la: list, lb: list, leaf: int, wa: np.ndarray, wb: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> list[tuple]:
    """Rows a against rows b, or against themselves if xb is xa; w: their weights, c: their ids, l: their leaves. For each side
    the ids, the weight newly linked to each, and the least id of its component here."""
    same, big = xb is xa, np.iinfo(np.int64).max
    na, nb = np.zeros(len(xa)), np.zeros(len(xb))
    chunks = []
    for at in range(0, len(xa), 512):
        link = xa[at : at + 512] @ xb.T >= COSINE
        if same:
            link[np.arange(len(link)), np.arange(at, at + len(link))] = False
        rows, cols = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
        if not len(rows):
            continue
        link = link[np.ix_(rows, cols)]
        chunks.append((at + rows, cols, np.packbits(link, axis=1)))
        # Those that share an earlier leaf were counted there.
        earlier = {v for r in rows.tolist() for v in la[at + r] if v < leaf} & {v for c in cols.tolist() for v in lb[c] if v < leaf}
        names = {v: k for k, v in enumerate(earlier)}
        if names:
            ma, mb = np.zeros((len(rows), len(names)), np.float32), np.zeros((len(cols), len(names)), np.float32)
            for m, ls, which in ((ma, la, at + rows), (mb, lb, cols)):
                for k, w in enumerate(which.tolist()):
                    for v in ls[w]:
                        if v in names:
                            m[k, names[v]] = 1
            link &= ma @ mb.T == 0
        link = link.astype(np.float32)
        na[at + rows] += link @ wb[cols]
        nb[cols] += wa[at + rows] @ link
    ta, tb = ca.copy(), ca.copy() if same else cb.copy()
    moved = bool(chunks)
    while moved:
        before = ta.copy(), tb.copy()
        for rows, cols, bits in chunks:
            link = np.unpackbits(bits, axis=1, count=len(cols)).astype(bool)
            ta[rows] = np.minimum(ta[rows], np.where(link, tb[cols][None, :], big).min(1))
            tb[cols] = np.minimum(tb[cols], np.where(link, ta[rows][:, None], big).min(0))
        if same:
            ta = tb = np.minimum(ta, tb)
        moved = (ta != before[0]).any() or (tb != before[1]).any()
    return [(ca, na, ta)] if same else [(ca, na, ta), (cb, nb, tb)]


def _compare(batches: Iterator[pa.RecordBatch], kinds: dict[int, type]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["leaf", "i", "j"]):
        leaf, i, j, b, cid, w, dim = (t[c].to_numpy() for c in ("leaf", "i", "j", "b", "cid", "n", "dim"))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(leaf) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0), [True]]))
        raw, lists = t["x"].to_pylist(), t["leaves"].to_pylist()
        found: list[tuple] = []
        for s, e in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            one, two = (s + np.flatnonzero(b[s:e] == x[s]) for x in (i, j))
            if not len(one) or not len(two):
                continue
            kind = kinds[len(raw[s]) // int(dim[s])]
            xs = []
            for p in (one, two):
                x = np.frombuffer(b"".join(raw[k] for k in p.tolist()), kind).reshape(len(p), -1).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                xs.append(x / np.linalg.norm(x, axis=1, keepdims=True))
            if i[s] == j[s]:
                xs[1] = xs[0]
            ls = [[lists[k] for k in p.tolist()] for p in (one, two)]
            for ids, n, to in _linked(*xs, *ls, int(leaf[s]), w[one].astype(float), w[two].astype(float), cid[one], cid[two]):
                hit = (n > 0) | (to != ids)
                if hit.any():
                    found.append((ids[hit], n[hit].astype(np.int64), to[hit]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found, strict=True)], ["cid", "n", "to"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    sc = vectors.sparkSession.sparkContext
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kinds = {4: np.float32, 8: np.float64}
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))

    def cleaned(batches):
        for b in batches:
            for rows, _, raw in _units(b["embedding"]):
                yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(rows)), pa.array(np.full(len(rows), len(raw[0]) // (4 if single else 8)) if raw else np.zeros(0, np.int64), pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "dim", "x"])

    good = mapped(v.where("vec_id is not null"), cleaned, "vec_id long, dim long, x binary").withColumn("h", F.xxhash64("x"))
    classes = good.groupBy("h", "dim", "x").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n"))
    classes = durable(classes.select(F.monotonically_increasing_id().alias("cid"), "h", "dim", "x", "rep", "n"))
    many = classes.count()
    least = SAMPLE / max(many, 1)
    kind = np.float32 if single else np.float64
    # Up to SAMPLE vectors by a hash: the bounded sample that fits the trees.
    by_dim: dict[int, list] = {}
    for r in classes.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(min(1, 0.9 * least) * (1 << 30))).select("dim", "x").limit(SAMPLE).toLocalIterator():
        by_dim.setdefault(r[0], []).append(np.frombuffer(r[1], kind).astype(np.float64))
    count = sum(map(len, by_dim.values()))
    rng = np.random.default_rng(SEED)
    forest = {}
    for d, x in sorted(by_dim.items()):
        x = np.array(x)
        x /= np.abs(x).max(1, keepdims=True)
        forest[d] = [Tree(x / np.linalg.norm(x, axis=1, keepdims=True), LEAF * count / max(many, 1), rng) for _ in range(TREES)]
    shared = sc.broadcast(forest)  # SAMPLE splits a tree at most
    place = {(d, t): k for k, (d, t) in enumerate((d, t) for d in sorted(forest) for t in range(TREES))}

    def route(batches):
        for b in batches:
            dims, raw = b["dim"].to_numpy(), b["x"].to_pylist()
            leaves: list[list[int]] = [[] for _ in raw]
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(raw[k] for k in at.tolist()), kind).reshape(len(at), -1).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if d not in shared.value:
                    # A length that the sample lacks has one leaf.
                    for k in at.tolist():
                        leaves[k].append(-d)
                for t, tree in enumerate(shared.value.get(d, [])):
                    for leaf, rows in tree.route(x):
                        for k in at[rows].tolist():
                            leaves[k].append(place[d, t] << 48 | leaf)
            yield pa.RecordBatch.from_arrays([b["cid"], b["dim"], b["x"], b["n"], pa.array([sorted(ls) for ls in leaves], pa.list_(pa.int64()))], ["cid", "dim", "x", "n", "leaves"])

    routed = mapped(classes.select("cid", "dim", "x", "n"), route, "cid long, dim long, x binary, n long, leaves array<long>")
    routed = durable(routed)
    # The key of a leaf's rows: a leaf of many blocks is compared block by block.
    large = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    large = durable(large)
    cells = routed.withColumn("leaf", F.explode("leaves")).join(F.broadcast(large) if large.count() <= FEW else large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    cells = cells.withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")
    cells = cells.select("*", other).select("cid", "dim", "x", "n", "leaves", "leaf", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    cells = cells.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "cid")
    found = durable(mapped(cells, lambda batches: _compare(batches, kinds), "cid long, n long, to long"))
    release(routed)

    links = found.groupBy("cid").agg(F.sum("n").alias("links")).join(classes.select("cid", "h", "dim", "x", "rep", F.col("n").alias("copies")), "cid", "right")
    links = durable(links.select("cid", "h", "dim", "x", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("copies").alias("n")))
    rep = classes.select("cid", "rep")
    near = found.select("cid", "to").distinct().join(rep.toDF("cid", "a"), "cid").join(rep.toDF("to", "b"), "to").select("a", "b")
    own = attach(good.select("h", "dim", "x", "vec_id").distinct(), links.select("h", "dim", "x", "rep", "links", "n"), ["h", "dim", "x"], v.count()).select("vec_id", "rep", "links")
    own = durable(own)
    roots = components(near.union(own.select("vec_id", "rep")).where("a <> b"))
    release(links, classes, found, large)
    ids = own.groupBy("vec_id").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("v", "vec_id"), "vec_id", "left")
    out = v.select("vec_id").join(ids, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
