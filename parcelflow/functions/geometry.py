"""Affine maps, rings, lines and pixel boxes, as column expressions. A geotransform is a struct (ox, pw, rx, oy, ry, ph)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PARALLEL = 1e-6


def geotransform(ox: float, pw: float, rx: float, oy: float, ry: float, ph: float) -> Column:
    return F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("ox", "pw", "rx", "oy", "ry", "ph"), (ox, pw, rx, oy, ry, ph), strict=True)))


def to_cell(x: Column, y: Column, g: Column) -> tuple[Column, Column]:
    """Column and row of the pixel that holds a world point; rotation is left out."""
    return F.floor((x - g.ox) / g.pw), F.floor((y - g.oy) / g.ph)


def to_world(c: Column, r: Column, g: Column) -> tuple[Column, Column]:
    return g.ox + c * g.pw + r * g.rx, g.oy + c * g.ry + r * g.ph


def to_pixel(x: Column, y: Column, g: Column) -> tuple[Column, Column]:
    """Fractional column and row, by the full inverse; null where the transform has none."""
    det = g.pw * g.ph - g.rx * g.ry
    det = F.when(det != 0, det)
    dx, dy = x - g.ox, y - g.oy
    return (dx * g.ph - dy * g.rx) / det, (dy * g.pw - dx * g.ry) / det


def line_to_world(points: Column, g: Column, col0: Column, row0: Column) -> Column:
    """A polyline of (c, r) inside a box that begins at (col0, row0), as world points (x, y)."""

    def one(p):
        x, y = to_world(p.c + col0, p.r + row0, g)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, one)


def shifted(g: Column, col0: Column, row0: Column) -> Column:
    """The transform of a box of the raster: its origin moves, its pixels stay."""
    x, y = to_world(col0, row0, g)
    return F.struct(x.alias("ox"), g.pw.alias("pw"), g.rx.alias("rx"), y.alias("oy"), g.ry.alias("ry"), g.ph.alias("ph"))


def signed_area(ring: Column) -> Column:
    """Of an open or closed ring of (x, y): positive if it runs counter-clockwise."""
    ahead = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    each = F.zip_with(ring, ahead, lambda a, b: a.x * b.y - b.x * a.y)
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / 2


def area(ring: Column) -> Column:
    return F.when(F.size(ring) >= 3, F.abs(signed_area(ring))).otherwise(0.0)


def closed(ring: Column) -> Column:
    """The ring with its first point again at the end; null if it holds no area."""
    return F.when(area(ring) > 0, F.concat(ring, F.slice(ring, 1, 1)))


def length(points: Column) -> Column:
    ahead = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    legs = F.transform(ahead, lambda p, i: F.hypot(p.x - points[i].x, p.y - points[i].y))
    return F.aggregate(legs, F.lit(0.0), lambda s, v: s + v)


def least_area(width: Column, g: Column) -> Column:
    """World area below which a face is noise: a square of ten strokes, 100 at least."""
    return F.greatest(F.lit(100.0), F.abs(g.pw * g.ph) * F.pow(10 * width, F.lit(2)))


def clip_margin(width: Column, g: Column) -> Column:
    return 4 * width * F.abs(g.pw)


def features(c0: Column, r0: Column, c1: Column, r1: Column) -> dict[str, Column]:
    """A segment's direction in [0, pi), distance of its line from the origin along the normal, and extent along the direction."""
    dx, dy = (c1 - c0).cast("double"), (r1 - r0).cast("double")
    angle = F.pmod(F.atan2(dy, dx), F.lit(math.pi))
    along = lambda c, r: c * F.cos(angle) + r * F.sin(angle)
    return {
        "length": F.sqrt(dx * dx + dy * dy), "angle": angle, "offset": r0 * F.cos(angle) - c0 * F.sin(angle),
        "tmin": F.least(along(c0, r0), along(c1, r1)), "tmax": F.greatest(along(c0, r0), along(c1, r1)),
    }


def extended(c0: Column, r0: Column, c1: Column, r1: Column, width: Column) -> tuple[Column, Column, Column, Column]:
    """Both ends pushed outwards by eight strokes, on whole pixels; null below a pixel of length."""
    dx, dy = (c1 - c0).cast("double"), (r1 - r0).cast("double")
    n = F.sqrt(dx * dx + dy * dy)
    n, by = F.when(n >= 1, n), F.rint(8 * width)
    ux, uy = dx / n, dy / n
    return F.rint(c0 - ux * by), F.rint(r0 - uy * by), F.rint(c1 + ux * by), F.rint(r1 + uy * by)


def crossing(a: Column, b: Column) -> tuple[Column, Column]:
    """Where the infinite lines through two segments (c0, r0, c1, r1) meet; null if they are parallel."""
    cross = lambda s: s.c0 * s.r1 - s.r0 * s.c1
    den = ((a.c0 - a.c1) * (b.r0 - b.r1) - (a.r0 - a.r1) * (b.c0 - b.c1)).cast("double")
    den = F.when(F.abs(den) >= PARALLEL, den)
    x = (cross(a) * (b.c0 - b.c1) - (a.c0 - a.c1) * cross(b)) / den
    y = (cross(a) * (b.r0 - b.r1) - (a.r0 - a.r1) * cross(b)) / den
    return x, y


def clamped_box(c0: Column, r0: Column, c1: Column, r1: Column, width: Column, height: Column, margin: Column | None = None) -> Column:
    """Half-open pixel box of two corners in any order, grown by a margin, inside a raster; null if nothing is left."""
    m = F.lit(0) if margin is None else margin
    into = lambda v, top: F.greatest(F.lit(0).cast("long"), F.least(v.cast("long"), top.cast("long")))
    box = [into(F.least(c0, c1) - m, width), into(F.least(r0, r1) - m, height), into(F.greatest(c0, c1) + 1 + m, width), into(F.greatest(r0, r1) + 1 + m, height)]
    made = F.struct(*(b.alias(k) for b, k in zip(box, ("col0", "row0", "col1", "row1"), strict=True)))
    return F.when((box[2] > box[0]) & (box[3] > box[1]), made)
