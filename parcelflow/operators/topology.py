"""Lines and faces: crossings, collinear lines, dominant lines, faces of a grid of lines, and shared edges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions.geometry import crossing

from .sheetwise import per_sheet

LINE = "sheet long, c0 long, r0 long, c1 long, r1 long"


def intersections(lines: DataFrame, width: int, height: int, slack: float = 0.05) -> DataFrame:
    """sheet, i, j, x, y: where the infinite lines of a sheet meet, in the image or little beyond; sheets of three lines or more.

    lines: sheet, i, c0, r0, c1, r1. The join is by sheet; a sheet has few lines (dominant ones, 24 at most)."""
    many = lines.withColumn("n_", F.count("*").over(Window.partitionBy("sheet"))).where("n_ >= 3")
    seg = F.struct("c0", "r0", "c1", "r1")
    a, b = many.select("sheet", "i", seg.alias("a")), many.select("sheet", F.col("i").alias("j"), seg.alias("b"))
    x, y = crossing(F.col("a"), F.col("b"))
    m = slack * max(width, height)
    out = a.join(b, "sheet").where("i < j").select("sheet", "i", "j", x.alias("x"), y.alias("y"))
    return out.where(F.col("x").between(-m, width + m) & F.col("y").between(-m, height + m))


def spaced(points: np.ndarray, least: float) -> np.ndarray:
    """The points (rows of x, y) that are farther than least from all kept before them."""
    kept: list = []
    for p in points:
        if all(math.dist(p, q) > least for q in kept):
            kept.append(p)
    return np.array(kept, float).reshape(-1, 2)


def around(points: np.ndarray) -> np.ndarray:
    """Points in the order of their angle round their middle."""
    d = points - points.mean(0)
    return points[np.argsort(np.arctan2(d[:, 1], d[:, 0]), kind="stable")]


def support_chains(crossings: DataFrame, width: int, height: int) -> DataFrame:
    """sheet, c0, r0, c1, r1: the closed chain through a sheet's crossings, rounded, near ones merged."""

    def one(i, j, x, y):
        p = np.rint(np.stack([x, y], 1))[np.lexsort((j, i))]
        p = spaced(p, 0.03 * min(width, height))
        if len(p) >= 3:
            p = around(p)
            yield from np.concatenate([p, np.roll(p, -1, 0)], 1).astype(int).tolist()

    return per_sheet(crossings.select("sheet", "i", "j", "x", "y"), one, LINE)


def _described(least: float):
    def of(b: pd.DataFrame) -> pd.DataFrame:
        dx, dy = (b.c1 - b.c0).to_numpy(float), (b.r1 - b.r0).to_numpy(float)
        angle = np.arctan2(dy, dx) % math.pi
        u = np.stack([np.cos(angle), np.sin(angle)])
        ends = np.stack([b.c0 * u[0] + b.r0 * u[1], b.c1 * u[0] + b.r1 * u[1]])
        f = b.assign(n=np.hypot(dx, dy), angle=angle, offset=b.r0 * u[0] - b.c0 * u[1], low=ends.min(0), high=ends.max(0))
        return f[f.n >= least].sort_values(["sheet", "n", "c0", "r0", "c1", "r1"], ascending=[True, False] + [True] * 4)

    return of


def _turn(a: float, b: float) -> float:
    d = abs(a - b)
    return min(d, math.pi - d)


def merge_collinear(segments: DataFrame, width: float, degrees: float = 8.0, factor: float = 1.8) -> DataFrame:
    """One line for each bundle of near-collinear segments of a sheet: at their mean direction and offset by length, over all they span.

    The longest come first and the bundle's running mean decides, so a sheet's segments are one task's."""

    def one(n, angle, offset, low, high, **_):
        bundles: list[np.ndarray] = []  # angle, offset, weight, low, high
        for row in np.stack([angle, offset, n, low, high], 1):
            fit = next((b for b in bundles if _turn(row[0], b[0]) <= math.radians(degrees) and abs(row[1] - b[1]) <= factor * width), None)
            if fit is None:
                bundles.append(row.copy())
            else:
                fit[:2] = (fit[:2] * fit[2] + row[:2] * row[2]) / (fit[2] + row[2])
                fit[2] += row[2]
                fit[3:] = min(fit[3], row[3]), max(fit[4], row[4])
        for a, o, _, least, most in bundles:
            u = np.array([math.cos(a), math.sin(a)])
            foot = o * np.array([-u[1], u[0]])
            yield tuple(np.rint(np.concatenate([foot + least * u, foot + most * u])).astype(int).tolist())

    return per_sheet(segments.select("sheet", "c0", "r0", "c1", "r1"), one, LINE, _described(1.0))


def dominant_lines(segments: DataFrame, width: float, most: int, degrees: float = 12.0, factor: float = 5.0) -> DataFrame:
    """The longest segment of each bundle round it, the longest first, at most so many a sheet."""

    def one(c0, r0, c1, r1, angle, offset, **_):
        kept: list[int] = []
        for k in range(len(angle)):
            if not any(_turn(angle[k], angle[j]) <= math.radians(degrees) and abs(offset[k] - offset[j]) <= factor * width for j in kept):
                kept.append(k)
        return [(int(c0[k]), int(r0[k]), int(c1[k]), int(r1[k])) for k in kept[:most]]

    return per_sheet(segments.select("sheet", "c0", "r0", "c1", "r1"), one, LINE, _described(10 * width))


def nodes(lines: DataFrame) -> DataFrame:
    """sheet, x, y: where upright lines (ori 1, at x = pos) and level ones (ori 0, at y = pos) of a sheet cross."""
    up, level = (lines.where(F.col("ori") == k).select("sheet", F.col("pos").alias(c)) for k, c in ((1, "x"), (0, "y")))
    return up.join(level, "sheet")


def cells(lines: DataFrame) -> DataFrame:
    """sheet, x0, x1, y0, y1: the faces between neighbouring lines of a sheet."""
    gap = lines.withColumn("next", F.lead("pos").over(Window.partitionBy("sheet", "ori").orderBy("pos"))).where("next is not null")
    across = gap.where("ori = 1").select("sheet", F.col("pos").alias("x0"), F.col("next").alias("x1"))
    return across.join(gap.where("ori = 0").select("sheet", F.col("pos").alias("y0"), F.col("next").alias("y1")), "sheet")


def edge_uses(faces: DataFrame) -> DataFrame:
    """sheet, edge (x0, y0, x1, y1, the lesser end first), uses: how many faces have it."""
    side = lambda *e: F.struct(*(F.col(c).alias(k) for c, k in zip(e, ("xa", "ya", "xb", "yb"), strict=True)))
    sides = F.array(side("x0", "y0", "x1", "y0"), side("x0", "y1", "x1", "y1"), side("x0", "y0", "x0", "y1"), side("x1", "y0", "x1", "y1"))
    return faces.select("sheet", F.explode(sides).alias("edge")).groupBy("sheet", "edge").agg(F.count("*").alias("uses"))


def outlines(uses: DataFrame) -> DataFrame:
    """sheet, n_shared, n_outer, perimeter of the union of a sheet's faces: edges of one face alone bound it."""
    outer = F.col("uses") == 1
    n = F.abs(F.col("edge.xb") - F.col("edge.xa")) + F.abs(F.col("edge.yb") - F.col("edge.ya"))
    return uses.groupBy("sheet").agg(F.count_if(~outer).alias("n_shared"), F.count_if(outer).alias("n_outer"), F.sum(F.when(outer, n).otherwise(0)).alias("perimeter"))
