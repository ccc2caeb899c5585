"""Glyph distances, class probabilities, label costs and their assignment to polygons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions.rules import natural_key, siblings

from .sheetwise import per_sheet

# A glyph may lie two pixels beside its template.
SHIFTS = ((0, 0), (2, 0), (-2, 0), (0, 2), (0, -2))


def rolled(v: Column, width: int, rows: int, cols: int, height: int) -> Column:
    """A grid, row by row in an array, rolled round by so many rows and columns."""
    at = F.sequence(F.lit(0), F.lit(width * height - 1))
    return F.transform(at, lambda i: v[F.pmod(F.floor(i / width) - rows, F.lit(height)).cast("int") * width + F.pmod(i % width - cols, F.lit(width)).cast("int")])


def mean_square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def char_distances(glyphs: DataFrame, library: DataFrame, width: int, height: int) -> DataFrame:
    """glyph, char, dist: each glyph's least distance, over small shifts, to the library's samples of each character.

    The library is one row a character (bounded by what people have labelled) and is broadcast, after its size is checked by Spark."""
    stacks = library.groupBy("char").agg(F.collect_list("v").alias("stack"))
    tried = F.array(*(rolled(F.col("v"), width, r, c, height) for r, c in SHIFTS))
    g = glyphs.withColumn("tries", tried).select("glyph", "tries").crossJoin(stacks)
    each = F.transform("tries", lambda t: F.array_min(F.transform("stack", lambda s: mean_square(t, s))))
    return g.select("glyph", "char", F.array_min(each).alias("dist"))


def read_row(chars: DataFrame) -> DataFrame:
    """marker, text, score: of each position (marker, pos, last, char, dist) the nearest character, letters in the last one only."""
    fit = chars.where(F.col("last") | F.col("char").rlike("^[0-9]$"))
    best = fit.groupBy("marker", "pos").agg(F.min(F.struct("dist", "char")).alias("b"))
    per = best.groupBy("marker").agg(F.array_sort(F.collect_list(F.struct("pos", "b.char"))).alias("cs"), F.avg("b.dist").alias("score"))
    return per.select("marker", F.array_join(F.transform("cs", lambda c: c["char"]), "").alias("text"), "score")


def softmax(row: Column) -> Column:
    e = F.transform(row, lambda x: F.exp(x - F.array_max(row)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def ensemble(members: Column) -> Column:
    """Logarithms of the mean over members (an array of logit arrays) of each class's probability, kept off 0."""
    p = F.transform(members, softmax)
    n = F.size(p)
    total = F.aggregate(p, F.transform(p[0], lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-9), x / n))))


def classified(logits: Column, classes: Column, final: Column, junk: str = "JUNK") -> Column:
    """char and conf: the likeliest class; before the last position only digits and junk compete."""
    pairs = F.zip_with(logits, classes, lambda x, c: F.struct(x.alias("x"), c.alias("c")))
    allowed = F.filter(pairs, lambda s: final | s.c.rlike("^[0-9]$") | (s.c == junk))
    p = softmax(F.transform(allowed, lambda s: s.x))
    top = F.array_max(p)
    return F.struct(allowed[F.array_position(p, top).cast("int") - 1].c.alias("char"), top.alias("conf"))


def read_text(chars: DataFrame, by: list[str], junk: str = "JUNK") -> DataFrame:
    """by, text, min_conf: characters (pos, char, conf) joined; none that holds junk or lacks the form of a number."""
    from parcelflow.functions.rules import shown

    per = chars.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "char"))).alias("cs"), F.min("conf").alias("min_conf"))
    per = per.where(~F.exists("cs", lambda c: c["char"] == junk)).withColumn("text", F.array_join(F.transform("cs", lambda c: c["char"]), ""))
    return per.where((F.length("text") >= 2) & shown(F.col("text"))).select(*by, "text", "min_conf")


def label_costs(fits: DataFrame) -> DataFrame:
    """sheet, poly_idx, label, cost: the least over markers of a label's mean distance by the marker's ownership.

    fits: sheet, poly_idx, label, marker_id, form, pos, dist (of a position to the form's character), inside (signed distance)."""
    from parcelflow.functions.rules import ownership

    near = fits.where("inside >= -180")
    form = near.groupBy("sheet", "poly_idx", "label", "marker_id", "form", "inside").agg(F.avg("dist").alias("mean"))
    return form.groupBy("sheet", "poly_idx", "label").agg(F.min(F.col("mean") * ownership(F.col("inside"))).alias("cost"))


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; every row or every column has one. Shortest augmenting paths."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    rows, cols = c.shape
    row_price, col_price, owner = np.zeros(rows), np.zeros(cols), np.full(cols, -1)
    for new in range(rows):
        dist, came, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        row, reached, at = new, 0.0, -1
        while True:
            through = reached + c[row] - row_price[row] - col_price
            closer = ~done & (through < dist)
            dist[closer], came[closer] = through[closer], at
            at = int(np.argmin(np.where(done, np.inf, dist)))
            reached, done[at] = dist[at], True
            if owner[at] < 0:
                break
            row = owner[at]
        row_price[new] += reached
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                row_price[owner[j]] += reached - dist[j]
            col_price[j] -= reached - dist[j]
        while at >= 0:
            back = int(came[at])
            owner[at] = new if back < 0 else owner[back]
            at = back
    pairs = [(int(owner[j]), j) for j in range(cols) if owner[j] >= 0]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def assigned(costs: DataFrame, impossible: float = 1e9) -> DataFrame:
    """sheet, poly_idx, label, cost: each polygon of a sheet with one label, at the least total cost. A sheet's matrix must fit in a task."""

    def solve(poly_idx, label, cost):
        rows, i = np.unique(poly_idx, return_inverse=True)
        cols, j = np.unique(label.astype(str), return_inverse=True)
        c = np.full((len(rows), len(cols)), impossible)
        np.minimum.at(c, (i, j), cost)
        return [(int(rows[x]), str(cols[y]), float(c[x, y])) for x, y in hungarian(c) if c[x, y] < impossible]

    return per_sheet(costs.select("sheet", "poly_idx", "label", "cost"), solve, "sheet long, poly_idx long, label string, cost double")


def without_unfair_siblings(pairs: DataFrame, labels: DataFrame, library: DataFrame) -> DataFrame:
    """Pairs (sheet, label) but those with a sibling label on the sheet that has a character without samples."""
    chars = labels.select("sheet", "label", F.explode(F.split(F.upper(F.trim("label")), "")).alias("char")).where("char <> ''")
    unsampled = chars.join(F.broadcast(library.select("char").distinct()), "char", "left_anti").select("sheet", F.col("label").alias("other")).distinct()
    bad = pairs.select("sheet", "label").join(unsampled, "sheet").where(siblings(F.col("label"), F.col("other"))).select("sheet", "label").distinct()
    return pairs.join(bad, ["sheet", "label"], "left_anti")


def in_order(polygons: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """by, poly_idx, label: the k-th polygon (rank) gets the k-th label in natural order; blank where labels run out."""
    k = natural_key(F.col("label"))
    pos = F.row_number().over(Window.partitionBy(by).orderBy(k, "label"))
    named = labels.withColumn("pos", pos)
    placed = polygons.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy("rank", "poly_idx")))
    return placed.join(named, [by, "pos"], "left").select(by, "poly_idx", F.coalesce("label", F.lit("")).alias("label"))


def merged(rows: DataFrame) -> DataFrame:
    """sheet, poly_idx, label: sure reads win; other polygons keep their spatial label while it is free, or else take the next free typed one.

    rows: sheet, poly_idx, spatial, read, sure, typed (the sheet's labels as typed). The order of polygons decides, so a sheet is one task's."""

    def one(poly_idx, spatial, read, sure, typed):
        order = np.argsort(poly_idx, kind="stable")
        out = {k: read[k] for k in order if sure[k] and read[k]}
        taken = {x.upper() for x in out.values()}
        free = [t for t in (typed[0] if typed[0] is not None else []) if t.strip() and t.strip().upper() not in taken]
        for k in order:
            if k in out:
                continue
            wish = (spatial[k] or "").strip()
            if not (wish and wish.upper() not in taken and wish in free):
                wish = free[0] if free else ""
            if wish:
                free.remove(wish)
                taken.add(wish.upper())
            out[k] = wish
        return [(int(poly_idx[k]), out[k]) for k in order]

    return per_sheet(rows.select("sheet", "poly_idx", "spatial", "read", "sure", "typed"), one, "sheet long, poly_idx long, label string")


def reading_order(points: DataFrame) -> DataFrame:
    """sheet, poly_idx, rank: along the longer axis of the group if it is a strip; else by rows from the top, each along that axis."""

    def one(poly_idx, x, y):
        by = np.argsort(poly_idx, kind="stable")
        d = np.stack([x, y], 1).astype(float)[by]
        d -= d.mean(0)
        _, axes = np.linalg.eigh(d.T @ d / len(d))
        across, along = (a if a[1] <= 0 else -a for a in axes.T)
        u, v = d @ along, d @ across
        if np.ptp(v) < 0.35 * np.ptp(u):
            order = np.argsort(-u, kind="stable")
        else:
            reach = 0.5 * (float(np.sqrt(np.median((d * d).sum(1)))) or 1.0)
            heads: list[float] = []
            row = np.zeros(len(d), int)
            for k in np.argsort(-v, kind="stable"):
                near = [r for r, h in enumerate(heads) if abs(v[k] - h) < reach]
                if not near:
                    heads.append(v[k])
                row[k] = near[0] if near else len(heads) - 1
            order = np.lexsort((-u, row))
        return [(int(poly_idx[by[k]]), r) for r, k in enumerate(order.tolist())]

    return per_sheet(points.select("sheet", "poly_idx", "x", "y"), one, "sheet long, poly_idx long, rank long")


def chain_order(edges: DataFrame, points: DataFrame) -> DataFrame:
    """sheet, poly_idx, rank of the sheets whose polygons (at least three) form one path by adjacency, from its end that is farthest north,
    then west. edges: sheet, a, b; points: sheet, poly_idx, x, y."""

    def walk(a, b, x, y):
        beside: dict = {int(p): set() for p, q in zip(a, b, strict=True) if q == -1}
        place = {int(p): (-v, u) for p, q, u, v in zip(a, b, x, y, strict=True) if q == -1}
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            if q != -1 and p != q and p in beside and q in beside:
                beside[p].add(q)
                beside[q].add(p)
        ends = [p for p, s in beside.items() if len(s) == 1]
        if len(beside) < 3 or len(ends) != 2 or any(not 1 <= len(s) <= 2 for s in beside.values()):
            return []
        path, seen = [min(ends, key=place.get)], set()
        while True:
            seen.add(path[-1])
            ahead = beside[path[-1]] - seen
            if not ahead:
                break
            path += ahead
        return [] if len(path) < len(beside) else [(p, k) for k, p in enumerate(path)]

    # A polygon's own row has -1 for its neighbour.
    own = points.select("sheet", F.col("poly_idx").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    both = own.unionByName(edges.select("sheet", "a", "b", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    return per_sheet(both, walk, "sheet long, poly_idx long, rank long")
