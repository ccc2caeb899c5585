"""Thresholds and connected components of small tiles (whole regions of interest)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def otsu(pixels: DataFrame) -> DataFrame:
    """tile, threshold: the value that parts a tile's pixels (tile, v) best; ink is at or below it. Only counts by value are sorted."""
    counts = pixels.groupBy("tile", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("tile").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("tile")
    w = counts.select("tile", "v", F.sum("n").over(upto).alias("w"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s"), F.sum("n").over(every).alias("n"), F.sum(F.col("n") * F.col("v")).over(every).alias("t"))
    gap = (F.col("t") * F.col("w") - F.col("n") * F.col("s")).cast("double")
    between = F.when(F.col("w") < F.col("n"), gap * gap / (F.col("w") * (F.col("n") - F.col("w"))).cast("double")).otherwise(0.0)
    return w.withColumn("between", between).groupBy("tile").agg(F.max(F.struct("between", -F.col("v"))).alias("b")).select("tile", (-F.col("b.col2")).alias("threshold"))


def _labels(ink: np.ndarray, corners: bool) -> np.ndarray:
    """Each ink pixel's component in a stack of tiles, by its first pixel's number; -1 elsewhere."""
    n, h, w = ink.shape
    big = h * w
    own = np.where(ink, np.arange(big).reshape(h, w), big)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * corners
    while True:
        wide = np.pad(own, ((0, 0), (1, 1), (1, 1)), constant_values=big)
        least = own
        for r, c in steps:
            least = np.minimum(least, wide[:, 1 + r : 1 + r + h, 1 + c : 1 + c + w])
        least = np.where(ink, least, big)
        if (least == own).all():
            return np.where(ink, own, -1)
        own = least


def components(tiles: DataFrame, height: int, width: int, corners: bool = True) -> DataFrame:
    """tile, comp, n, h, w: connected ink of each tile (tile, ink: array of boolean, row by row); comp is the number of its first pixel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ink = np.array([np.asarray(x, bool) for x in b.ink]).reshape(len(b), height, width)
            t, r, c = np.nonzero(ink)
            found = pd.DataFrame({"tile": b.tile.to_numpy()[t], "comp": _labels(ink, corners)[t, r, c], "r": r, "c": c})
            g = found.groupby(["tile", "comp"], as_index=False).agg(n=("r", "size"), r0=("r", "min"), r1=("r", "max"), c0=("c", "min"), c1=("c", "max"))
            yield pd.DataFrame({"tile": g.tile, "comp": g.comp, "n": g.n, "h": g.r1 - g.r0 + 1, "w": g.c1 - g.c0 + 1})

    return tiles.select("tile", "ink").mapInPandas(run, "tile long, comp long, n long, h long, w long")


def strokes(comps: DataFrame, width: float) -> DataFrame:
    """Components that are no text: long in some direction, or sparse in their box."""
    return comps.where((F.greatest("h", "w") >= 8 * width) | (F.col("n") / (F.col("h") * F.col("w")) < 0.20))


def line_width(opened: DataFrame) -> DataFrame:
    """sheet, radius, stroke_px from the area left after opening by each radius (sheet, radius, area, radius 0 first): the last radius
    that loses a quarter of the greatest loss; 12 where nothing is lost."""
    from parcelflow.functions.rules import stroke_width

    loss = F.lag("area").over(Window.partitionBy("sheet").orderBy("radius")) - F.col("area")
    d = opened.withColumn("loss", loss).where("loss is not null")
    d = d.withColumn("peak", F.max("loss").over(Window.partitionBy("sheet")))
    last = d.groupBy("sheet").agg(F.max(F.when((F.col("peak") > 0) & (F.col("loss") >= 0.25 * F.col("peak")), F.col("radius"))).alias("radius"))
    return last.withColumn("stroke_px", F.coalesce(stroke_width(F.col("radius")), F.lit(12)))
