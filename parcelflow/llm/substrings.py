"""Substring dedup behind a count-min prefilter.

A window of 35 words can only repeat if every shorter run of words in it repeats. Each window is represented by the least of
the hashes of its 16-word runs (all places with that hash in it), so the sketch takes in about a tenth of the positions.
Every partition fills a count-min sketch (DEPTH rows of cells, counts held at two); the partitions' sketches are merged by
addition and give a bitmap of the cells that count two or more. A run with a cell below two is unique for certain, and so are
the windows it represents; collisions only leave more in doubt, so nothing is lost.

The second pass groups the doubtful runs exactly, then by a 128-bit hash the windows that repeated runs represent. The number
of cells grows with the corpus up to 2^MOST_BITS a row, which bounds the broadcast bitmaps (32 MB a row). A larger corpus
fills them: then the prefilter holds back less, and the runs, a tenth of the positions, are grouped exactly.

Null texts have no words; texts with fewer than 35 words lose none. Rows are told apart by a key of their own, so rows that
repeat an id or a text are documents like others: what they share stands several times. Ties don't arise. Only doc_id and text
are read, whatever other columns are named. A text must fit in a task; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_BYTES, attach, durable, mapped, release, sieve, slabs, table, word_hashes

WINDOW, RUN, DEPTH, MOST_BITS, CHUNK_BITS = 35, 16, 2, 28, 21
SPACE, SAME = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]), np.arange(256, dtype=np.uint8)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
# Cells that a task holds before it gives them on.
HELD = 4 << 20


def _rolling(h: np.ndarray, n: int, odd: int) -> np.ndarray:
    """Hash of each n values in a row."""
    inverse = np.uint64(pow(odd, -1, 1 << 64))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h) - 1, inverse)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h) - 1, np.uint64(odd))]), dtype=np.uint64)
    s = np.concatenate([[np.uint64(0)], np.cumsum(h * power, dtype=np.uint64)])
    x = (s[n:] - s[:-n]) * back[: len(h) - n + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    done = 1
    while done < n:
        step = min(done, n - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def _marks(texts: pa.Array, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs that represent some window: hash, text (by its place), position."""
    h, at = word_hashes(texts, SPACE, SAME)
    starts, sizes = at[:-1], np.diff(at)
    long = np.flatnonzero(sizes >= window)
    empty = np.zeros(0, np.int64)
    if not len(long):
        return np.zeros(0, np.uint64), empty, empty
    r = _rolling(h, run, _ODD[0])
    n = window - run + 1
    found = []
    for k in long.tolist():
        x = r[starts[k] : starts[k] + sizes[k] - run + 1]
        least = _sliding(x, n, np.minimum)
        edge = np.zeros(n - 1, np.uint64)
        p = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), n, np.maximum) == x)
        found.append((x[p], np.full(len(p), k), p))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _cells(r: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    return [((r * np.uint64(2 * d + 0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64) for d in range(depth)]


def _sketch(rows: DataFrame, window: int, run: int, depth: int, bits: int) -> list[np.ndarray]:
    """Bitmaps, one a row of the sketch, of the cells that count two or more over the whole corpus."""
    chunk = min(bits, CHUNK_BITS)
    width = 1 << chunk

    def own(held):
        """The partition's sketch, without its empty cells: 2 x place in the chunk + whether it counts two or more."""
        for d, cells in enumerate(zip(*held, strict=True)):
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            cut = np.searchsorted(cell, np.arange(1, (1 << (bits - chunk)) + 1) << chunk)
            for c, (x, m) in enumerate(zip(np.split(cell, cut[:-1]), np.split(n, cut[:-1]), strict=True)):
                if len(x):
                    yield d, c, ((x & (width - 1)) * 2 + (m > 1)).astype("<u4").tobytes()

    def fill(batches):
        held, size = [], 0

        def given():
            got = list(own(held))
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.binary())], ["d", "c", "cells"])

        for b in slabs(batches, size=HASH_BYTES):
            r = _marks(b["text"], window, run)[0]
            held.append(_cells(r, depth, bits))
            size += len(r)
            if size > HELD:
                yield given()
                held, size = [], 0
        if held:
            yield given()

    def add(batches):
        """Counts are held at two, as two bitmaps: at least one, at least two. Rows come sorted by chunk."""
        key = once = twice = None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(once).tobytes()], pa.binary()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["d", "c", "once", "twice"])

        for b in batches:
            for d, c, cells in zip(*(b[x].to_pylist() for x in ("d", "c", "cells")), strict=True):
                if key != (d, c):
                    if key:
                        yield out()
                    key, once, twice = (d, c), np.zeros(width, bool), np.zeros(width, bool)
                x = np.frombuffer(cells, "<u4")
                at = x >> 1
                twice[at] |= once[at] | ((x & 1) > 0)
                once[at] = True
        if key:
            yield out()

    sparse = mapped(rows, fill, "d int, c int, cells binary")
    # Salted: a chunk's sketches are added in several tasks, and their sums in the end.
    salts = max(1, int(rows.rdd.getNumPartitions() ** 0.5) // 4)
    parts = sparse.withColumn("salt", F.pmod(F.xxhash64("cells"), F.lit(salts))).repartition("d", "c", "salt").sortWithinPartitions("salt", "d", "c")
    sums = durable(mapped(parts.select("d", "c", "cells"), add, "d int, c int, once binary, twice binary"))
    out = [np.zeros(max(1, 1 << bits >> 3), np.uint8) for _ in range(depth)]
    some = [x.copy() for x in out]
    size = max(1, width >> 3)
    for r in sums.toLocalIterator():  # at most depth x 2^(bits - chunk) x salts rows of two bitmaps of 2^(chunk - 3) bytes
        s = slice(r["c"] * size, (r["c"] + 1) * size)
        a, b = np.frombuffer(r["once"], np.uint8), np.frombuffer(r["twice"], np.uint8)
        out[r["d"]][s] |= b | (some[r["d"]][s] & a)
        some[r["d"]][s] |= a
    release(sums)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, depth: int = DEPTH, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text): without words that repeated windows cover. bits: of the sketch's width; else eight to 16 cells
    for each run that it is expected to take in."""
    rows = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")))
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(CHUNK_BITS, (size // 8).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(_sketch(rows, window, run, depth, bits))

    def doubtful(batches):
        for b in slabs(batches, size=HASH_BYTES):
            r, k, p = _marks(b["text"], window, run)
            ok = np.ones(len(r), bool)
            for bitmap, cell in zip(shared.value, _cells(r, depth, bits), strict=True):
                ok &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([pa.array(b["row"].to_numpy()[k[ok]]), pa.array(p[ok].astype(np.int32)), pa.array(r[ok].view(np.int64))], ["row", "at", "h"])

    marks = durable(mapped(rows, doubtful, "row long, at int, h long"))
    often = marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    runs = attach(marks, often, "h", marks.count()).groupBy("row").agg(F.array_sort(F.collect_list("at")).alias("at"))
    runs = durable(runs)
    release(marks)

    def windows(batches):
        """The windows near repeated runs, told apart within a task first. Those that stand there twice are hits, given by row
        in at; of equal ones the first goes on, to be counted with those of other tasks, and so do single ones."""
        n, found, size = window - run + 1, [], 0
        names = ["row", "at", "ha", "hb", "n"]

        def given():
            row, at, ha, hb = (np.concatenate(f) for f in zip(*found, strict=True))
            order = np.lexsort((hb, ha))
            ha, hb = ha[order], hb[order]
            first = np.concatenate([[True], (ha[1:] != ha[:-1]) | (hb[1:] != hb[:-1])])
            many = np.diff(np.append(np.flatnonzero(first), len(first)))
            again = many[np.cumsum(first) - 1] > 1
            # In the order of the texts again: equal keys of rows in sequence compress well on their way.
            back = np.argsort(order[first])
            lone, many = order[first][back], many[back]
            of = [pa.array(x) for x in (row[lone], at[lone], ha[first][back], hb[first][back])]
            hit = np.sort(order[again])
            ends = np.flatnonzero(np.append(row[hit][1:] != row[hit][:-1], True)) + 1 if len(hit) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(at[hit]))
            yield pa.RecordBatch.from_arrays([pa.array(row[hit][ends - 1]), lists, *(pa.nulls(len(ends), t) for t in (pa.int64(), pa.int64(), pa.int32()))], names)
            for k in range(0, len(lone), 100_000):
                part = [x[k : k + 100_000] for x in of]
                single = pa.ListArray.from_arrays(np.arange(len(part[0]) + 1, dtype=np.int32), part[1])
                yield pa.RecordBatch.from_arrays([part[0], single, part[2], part[3], pa.array(np.minimum(many[k : k + 100_000], 2).astype(np.int32))], names)

        for b in slabs(batches, size=HASH_BYTES):
            (ha, begin), (hb, _) = (word_hashes(b["text"], SPACE, SAME, w) for w in (0, 1))
            for key, x, y, at in zip(b["row"].to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), b["at"].to_pylist(), strict=True):
                flag = np.zeros(y - x - run + 2, np.int64)
                flag[np.array(at)] = 1
                near = np.cumsum(np.concatenate([[0], flag[:-1]]))
                p = np.flatnonzero(near[n:] - near[:-n] > 0)
                found.append((np.full(len(p), key, np.int64), p.astype(np.int32), *(_rolling(h[x:y], window, odd)[p].view(np.int64) for h, odd in zip((ha, hb), _ODD, strict=True))))
                size += len(p)
            if size > HELD // 2:
                yield from given()
                found, size = [], 0
        if found:
            yield from given()

    def repeated(batches):
        """Of rows sorted by window those whose window stands anywhere else; a run of equal windows isn't held but by its first row."""
        held = None
        names = ["row", "at"]
        for b in batches:
            if not len(b):
                continue
            row, at, ha, hb, n = (b[c].to_numpy() for c in ("row", "at", "ha", "hb", "n"))
            if held is not None:
                row, at, ha, hb, n = (np.concatenate([[h], x]) for h, x in zip(held, (row, at, ha, hb, n), strict=True))
            first = np.concatenate([[True], (ha[1:] != ha[:-1]) | (hb[1:] != hb[:-1])])
            starts = np.flatnonzero(first)
            twice = (np.add.reduceat(n, starts) > 1)[np.cumsum(first) - 1]
            # The last row waits: what follows may equal it. Held as counted, it makes those that follow hits.
            twice[-1] = False
            k = starts[-1]
            held = (row[-1], at[-1], ha[-1], hb[-1], min(2, n[k:].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(row[twice].astype(np.int64)), pa.array(at[twice].astype(np.int32))], names)
            # Equal windows in this batch but the last are hits already if there are several; a single one waits.
        if held is not None and held[4] > 1:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32())], names)

    maybe, _ = sieve(rows, runs, ["row"])
    seen = mapped(maybe.join(runs, "row").select("row", "text", "at"), windows, "row long, at array<int>, ha long, hb long, n int")
    own = seen.where("ha is null").select("row", "at")
    others = seen.where("ha is not null").select("row", "n", "ha", "hb", F.col("at")[0].alias("at"))
    others = mapped(others.repartition("ha", "hb").sortWithinPartitions("ha", "hb"), repeated, "row long, at int")
    hits = own.unionByName(others.groupBy("row").agg(F.collect_list("at").alias("at")))
    hits = durable(hits.groupBy("row").agg(F.flatten(F.collect_list("at")).alias("hits")))
    release(runs)

    def cut(batches):
        for b in slabs(batches):
            out = []
            for t, at in zip(b["text"].to_pylist(), b["hits"].to_pylist(), strict=True):
                kept = ws = t.encode().split() if t else []
                if at:
                    edge = np.zeros(len(ws) + 1, np.int64)
                    at = np.array(at)
                    edge[at] += 1
                    edge[at + window] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
                out.append((len(ws), len(ws) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept"])

    maybe, others = sieve(rows, hits, ["row"])
    both = maybe.join(hits, "row", "left").select("doc_id", "text", "hits").unionByName(others.select("doc_id", "text", F.lit(None).cast("array<int>").alias("hits")))
    return mapped(both, cut, "doc_id long, n_words long, n_removed long, kept string")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
