"""Gates, weights, option lists and label forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import PARTS, normalized, trimmed, valid

# Gates and forms.
AUTO, SUGGEST, SELECT = 0.90, 0.50, 0.30
FREE_COST, MATCH_COST, MATCH_MARGIN = 200.0, 4200.0, 1.20
DISPLAY = r"^([0-9]{1,4}|[0-9]{1,3}[A-ZÑ])$"
FILE = r"^([0-9]+)#([0-9]{2})-([0-9]{2})-([0-9]{3})-([0-9]{4})-([0-9]{4})(?:#|$)"
META = ("nmp", "dep", "mun", "sec", "chac", "mz", "fecha")


def file_parts(name: Column) -> dict[str, Column]:
    """Sheet number and block parts that a file name gives; all null where it has another form."""
    hit = name.rlike(FILE)
    part = lambda k: F.when(hit, F.regexp_extract(name, FILE, k))
    bare = F.regexp_replace(part(1), "^0+", "")
    return {"nmp": F.when(bare == "", "0").otherwise(bare), **{k: part(i) for i, k in enumerate(META[1:6], 2)}}


def sidecar_path(path: Column) -> Column:
    return F.concat(path, F.lit(".meta.json"))


def crop_name(nmp: Column, label: Column) -> Column:
    return F.concat(F.when(trimmed(nmp) == "", "unknown").otherwise(trimmed(nmp)), F.lit("_"), label, F.lit(".png"))


def label_list(typed: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(typed, F.lit("")), ","), trimmed), lambda x: x != "")


def natural_key(label: Column) -> Column:
    """Numbers first, by value and then letter; whatever is no number after them, by text."""
    t = trimmed(label)
    form = r"^([0-9]+)([A-Za-zÑñ]?)$"
    number = t.rlike(form)
    return F.struct((~number).alias("other"), F.when(number, F.regexp_extract(t, form, 1).cast("decimal(38,0)")).otherwise(0).alias("number"), F.when(number, F.upper(F.regexp_extract(t, form, 2))).otherwise(F.upper(t)).alias("rest"))


def display_forms(number: Column) -> Column:
    """Ways a number is written on a sheet, the shorter first."""
    n = F.upper(trimmed(number))
    bare = F.regexp_replace(n, "^0+", "")
    forms = F.array(n, F.when(bare == "", "0").otherwise(bare), F.when(n.rlike("^[0-9]{3}[A-ZÑ]$"), F.substring(n, 2, 9)), F.when(n.rlike("^00[0-9]{2}$"), F.substring(n, 3, 9)))
    keyed = F.transform(F.array_distinct(F.array_compact(forms)), lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s.v)


def shown(text: Column) -> Column:
    return text.rlike(DISPLAY)


def band(conf: Column) -> Column:
    return F.when(conf >= AUTO, "auto").when(conf >= SUGGEST, "suggest").otherwise("none")


def ownership(dist: Column) -> Column:
    """Weight of a marker's cost by its signed distance to the polygon's edge."""
    return F.when(dist < 0, 1.30).otherwise(1 + 0.30 * F.exp(-dist / 100.0))


def sweep(prior: Column) -> Column:
    """Angles to try: around the prior and its opposite, or all round without one."""
    wide = F.transform(F.sequence(F.lit(-45), F.lit(45), F.lit(5)), lambda a: a.cast("double"))
    steps = F.array(*(F.lit(float(s)) for s in (0, -5, 5, -10, 10)))
    near = F.flatten(F.transform(F.array(F.lit(0.0), F.lit(180.0)), lambda h: F.transform(steps, lambda s: F.pmod(prior + h + s + 180, F.lit(360.0)) - 180)))
    return F.when(prior.isNull(), wide).otherwise(F.array_distinct(near))


def widths(auto: Column) -> Column:
    """Stroke widths to try, in order: the automatic one, then narrower ones from three on."""
    tried = F.array(F.rint(0.6 * auto).cast("int"), F.rint(0.4 * auto).cast("int"), F.lit(4))
    return F.array_distinct(F.concat(F.array(auto.cast("int")), F.filter(tried, lambda v: (v >= 3) & (v < auto))))


def stroke_width(radius: Column) -> Column:
    return F.when(radius.isNotNull(), F.greatest(F.lit(6), F.least(F.lit(16), F.rint(4.8 * radius)))).cast("int")


def padded(name: str, part: Column) -> Column:
    """A block part in its width; blank unless digits that fit."""
    w = dict(PARTS)[name]
    return F.when(trimmed(part).rlike(f"^[0-9]{{1,{w}}}$"), F.lpad(trimmed(part), w, "0")).otherwise("")


def review_faults(number: Column, sec: Column, mz: Column) -> Column:
    """What keeps a reviewed row from being saved."""
    n = trimmed(number)
    return F.array_compact(F.array(
        F.when((n != "") & ~valid(n), "number"), F.when(~trimmed(sec).rlike("^[0-9]{1,3}$"), "sec"), F.when(~trimmed(mz).rlike("^[0-9]{1,4}$"), "mz")))


def harvestable(number: Column, source: Column) -> Column:
    """A spatial guess is no label to learn from."""
    return (trimmed(number) != "") & source.isin("typed", "ocr", "user", "click")


def feature_code(block: Column, number: Column) -> Column:
    """The parcel's code if it has a number, or else its block's."""
    n = normalized(number)
    return F.when((block != "") & F.length(n).between(1, 4), F.concat(block, n)).when(n == "", block).otherwise("")


def siblings(a: Column, b: Column) -> Column:
    """Different labels that one substituted or one missing character at an end tells apart."""
    x, y = F.upper(trimmed(a)), F.upper(trimmed(b))
    same = F.length(x) == F.length(y)
    differ = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p != q), lambda v: v))
    within = (F.abs(F.length(x) - F.length(y)) == 1) & (F.contains(x, y) | F.contains(y, x))
    return (x != y) & F.when(same, differ <= 1).otherwise(within)
