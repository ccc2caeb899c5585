"""Parcel numbers and fixed-width cadastral codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a block code and their widths.
PARTS = (("dep", 2), ("mun", 2), ("sec", 3), ("chac", 4), ("mz", 4))


def trimmed(c: Column) -> Column:
    """Without white space, of any script, at both ends; null is blank."""
    space = r"[\s\x1c-\x1f\x85\p{Z}]+"
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"^{space}|{space}$", "")


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _filled(t: Column) -> Column:
    signed = F.when(t.rlike("^[+-]"), F.concat(F.substring(t, 1, 1), F.lpad(F.substring(t, 2, 9), 3, "0")))
    return F.when((t == "") | (F.length(t) >= 4), t).otherwise(F.coalesce(signed, F.lpad(t, 4, "0")))


def normalized(number: Column) -> Column:
    """Upper case, padded to four behind a sign; blank stays blank and longer numbers stay whole."""
    return let(F.upper(trimmed(number)), _filled)


def is_valid(n: Column) -> Column:
    """Of a normalized number."""
    digits = F.regexp_extract(n, "^[0-9]+", 0).try_cast("int")
    return n.rlike("^[0-9]{3}[0-9A-ZÑ]$") & (F.coalesce(digits, F.lit(0)) >= 1)


def valid(number: Column) -> Column:
    return let(normalized(number), is_valid)


def block_code(parts: dict[str, Column]) -> Column:
    """The padded parts joined; blank if a part isn't 1 to width digits."""
    fit = lambda w: lambda p: F.when(p.rlike(f"^[0-9]{{1,{w}}}$"), F.lpad(p, w, "0"))
    return F.coalesce(F.concat(*(let(trimmed(parts[name]), fit(width)) for name, width in PARTS)), F.lit(""))


def code_of(block: Column, n: Column) -> Column:
    """Of a normalized number."""
    return F.when((block != "") & F.length(n).between(1, 4), F.concat(block, n)).otherwise("")


def parcel_code(block: Column, number: Column) -> Column:
    return let(normalized(number), lambda n: code_of(block, n))
