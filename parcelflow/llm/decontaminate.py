"""Benchmark decontamination with sparse suffix arrays over document shards.

Each shard (a slab of documents) gets an array of its word suffixes, sorted; every benchmark suffix is
binary-searched in it, and equal ranges give all places where a window occurs. Suffixes whose first
words begin no benchmark window can equal none and are left out of the array. Only the benchmark
travels, in blocks of about BLOCK_BYTES characters, so documents are never shuffled. With several blocks each row
gets a key, fixed by a checkpoint, and the rows that a block hits are merged by it.

Null or empty texts have no words: n_words 0, not contaminated. Null or empty benchmark texts, and
items with a null id, have no windows. Repeated rows each give their own row, null ids included; equal items are hit together.
Only doc_id, text and item_id are read, whatever other columns are named. A text must fit in a task. An empty
benchmark hits nothing, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mapped, slabs, table

WINDOW = 10
BLOCK_BYTES = 4 << 20
PRUNE_BITS = 22
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _prefix_codes(ids: np.ndarray, m: int) -> np.ndarray:
    code = np.zeros(len(ids), np.uint64)
    padded = np.concatenate([ids, np.zeros(m, ids.dtype)]).astype(np.uint64)
    for j in range(m):
        code = (code ^ padded[j : j + len(ids)]) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - PRUNE_BITS)).astype(np.int64)


def _keys(ids: np.ndarray, at: np.ndarray, width: int, fill: int = 0) -> np.ndarray:
    padded = np.concatenate([ids, np.zeros(width, ids.dtype)]).astype(">u4")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[at]).view(f"S{4 * width}").ravel()


class TestSuffixes:
    """The benchmark's words as ids, and its suffixes that start a window."""

    def __init__(self, items: list[tuple], window: int = WINDOW) -> None:
        self.width, self.ids_of, flat, starts, lengths, owner = window, {}, [], [], [], []
        for item, text in items:
            ws = words(text)
            if not ws or item is None:
                continue
            n = min(window, len(ws))
            for i in range(len(ws) - n + 1):
                starts.append(len(flat) + i)
                lengths.append(n)
                owner.append(str(item))
            flat += [self.ids_of.setdefault(w, len(self.ids_of) + 2) for w in ws] + [0]
        self.flat, self.starts, self.lengths = np.array(flat, np.uint32), np.array(starts, np.int64), np.array(lengths, np.int64)
        self.owner = owner
        if not starts:
            return
        self.prefix = int(min(4, self.lengths.min()))
        self.begins = np.zeros(1 << PRUNE_BITS, bool)
        self.begins[_prefix_codes(self.flat, self.prefix)[self.starts]] = True
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.flat, np.zeros(window, np.uint32)]), window)[self.starts]
        past = np.arange(window)[None, :] >= self.lengths[:, None]
        order = [np.ascontiguousarray(np.where(past, f, rows).astype(">u4")).view(f"S{4 * window}").ravel() for f in (0, 0xFFFFFFFF)]
        self.low, first, self.which = np.unique(order[0], return_index=True, return_inverse=True)
        self.high, self.span = order[1][first], self.lengths[first]
        by = np.argsort(self.which, kind="stable")
        self.uses, self.use_at = by, np.searchsorted(self.which[by], np.arange(len(self.low) + 1))

    def search(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int, str]]]]:
        """For each text its number of words and its matches (first word, words, item), joined to longest runs."""
        docs = [words(t) for t in texts]
        sizes = np.array([len(d) for d in docs], np.int64)
        if not len(self.starts):
            return [(int(n), []) for n in sizes]
        get, flat = self.ids_of.get, []
        for d in docs:
            flat += [get(w, 1) for w in d]
            flat.append(0)
        ids, ends = np.array(flat, np.uint32), np.cumsum(sizes + 1)
        at = np.flatnonzero(self.begins[_prefix_codes(ids, self.prefix)] & (ids > 1))
        keys = _keys(ids, at, self.width)
        order = np.argsort(keys, kind="stable")
        suffixes, keys = at[order], keys[order]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        found = np.flatnonzero(hi > lo)
        out = [(int(n), []) for n in sizes]
        if not len(found):
            return out
        pos = np.concatenate([suffixes[lo[w] : hi[w]] for w in found])
        win = np.repeat(found, (hi - lo)[found])
        many = (self.use_at[1:] - self.use_at[:-1])[win]
        use = self.uses[np.repeat(self.use_at[win], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        pos, occ, length = np.repeat(pos, many), self.starts[use], self.lengths[use]
        order = np.lexsort((pos, occ - pos))
        pos, occ, length, use = pos[order], occ[order], length[order], use[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(occ - pos) != 0) | (np.diff(pos) != 1)]))
        last = np.concatenate([new[1:], [len(pos)]]) - 1
        doc = np.searchsorted(ends, pos[new], "right")
        base = ends - sizes - 1
        for d, p, n, u in zip(doc.tolist(), pos[new].tolist(), (pos[last] + length[last] - pos[new]).tolist(), use[new].tolist(), strict=True):
            out[d][1].append((p - int(base[d]), n, self.owner[u]))
        return out


SCHEMA = "doc_id long, n_words long, matches array<struct<start:long,length:long,item:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string())]))


def _blocks(benchmark: DataFrame):
    """Items in blocks of about BLOCK_BYTES of text; in memory a block takes some forty times as much."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len((row[1] or "").encode())
    if block:
        yield block


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a match, in all their columns: one search after another, of which each moves nothing."""
    sc = docs.sparkSession.sparkContext
    for block in _blocks(benchmark):
        shared = sc.broadcast(TestSuffixes(block, window))

        def run(batches, shared=shared):
            for b in slabs(batches):
                got = shared.value.search(b["text"].to_pylist())
                yield b.filter(pa.array([not x[1] for x in got], pa.bool_()))

        docs = mapped(docs, run, docs.schema)
    return docs


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: n_words and its longest verbatim matches with every item (SCHEMA)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sc = docs.sparkSession.sparkContext

    def search(rows: DataFrame, items: list[tuple], every: bool) -> DataFrame:
        """The rows with n_words and matches; all of them, or only those with a match."""
        shared = sc.broadcast(TestSuffixes(items, window))
        names = [c for c in rows.columns if c != "text"]

        def run(batches):
            for b in slabs(batches):
                got = shared.value.search(b["text"].to_pylist())
                spans = [[{"start": s, "length": n, "item": i} for s, n, i in x[1]] for x in got]
                out = pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array([x[0] for x in got], pa.int64()), pa.array(spans, _SPANS)], [*names, "n_words", "matches"])
                yield out if every else out.filter(pa.array([bool(x[1]) for x in got], pa.bool_()))

        return mapped(rows, run, ", ".join([*(f"{c} long" for c in names), SCHEMA.split(", ", 1)[1]]))

    found, keyed, held = [], None, None
    for block in _blocks(benchmark):
        if held is not None:
            if keyed is None:
                keyed = durable(docs.withColumn("row", F.monotonically_increasing_id()))
            found.append(search(keyed, held, not found))
        held = block
    if not found:
        return search(docs, held or [], True)
    found.append(search(keyed, held, False))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    merged = whole.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    return merged.drop("row")


def _digest(spans: list[dict], n: int) -> tuple[int, int, str, int]:
    hit, end = 0, 0
    for s in sorted((s["start"], s["length"]) for s in spans):
        hit += max(0, s[0] + s[1] - max(end, s[0]))
        end = max(end, s[0] + s[1])
    items = sorted({s["item"] for s in spans})
    return hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), max([0, *(s["length"] for s in spans)])


def report(found: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [_digest(s or [], 0) for s in b["matches"].to_pylist()]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_words"], *cols, pa.array([g[0] > 0 for g in got], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "longest", "contaminated"])

    return mapped(found, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, longest long, contaminated boolean")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
