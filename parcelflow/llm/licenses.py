"""License scans with DataFrame functions only.

Each text window (WIDTH words, every STEP words, so windows overlap) has a MinHash of BANDS one-row
bands over its five-word shingles. A band value that a window of a template has too retrieves that template; exact containment
of the template's shingles in the document's then verifies it. Windows of a verbatim template collide for
certain where aligned; one shared shingle of a window's two is missed with probability 2^-BANDS.

Templates are a bounded parameter (TEMPLATES by default), held as literals. A template of at most eight words is found
only whole, as 0.8 of its shingles are all of them; so forms that tell versions apart are short. The FAMILIES, names without a version, count
only where no template of the family is found. SPDX lines give the identifiers in them, whatever their length.

Null, empty and short texts have no shingles and, but for SPDX lines, no license: a form of fewer than
five words ("MIT License") is not found. Repeated rows each get a row.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHINGLE, WIDTH, STEP, BANDS, CONTAINMENT, MAX_TEMPLATES = 5, 6, 2, 16, 0.8, 1000
# A band orders hashes by their value under its mask (xor): of two hashes, a random mask puts each first with chance 1/2.
_RANDOM = random.Random(1)
MASKS = [_RANDOM.getrandbits(64) - (1 << 63) for _ in range(BANDS)]
# Wording of license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004",
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-notice": "it under the terms of the GNU Lesser General Public License",
    "AGPL-notice": "it under the terms of the GNU Affero General Public License",
    "MPL-2.0-name": "Mozilla Public License Version 2.0",
    "MPL-2.0-short": "the Mozilla Public License 2.0",
    "BSD-2-Clause": "the BSD 2-Clause License",
    "BSD-3-Clause": "the BSD 3-Clause License",
    "BSD-2-Clause-first": "the 2-Clause BSD License",
    "BSD-3-Clause-first": "the 3-Clause BSD License",
    "CC0-1.0": "the CC0 1.0 Universal",
    "CC0-1.0-name": "Creative Commons Zero v1.0 Universal",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
for _kind, _short in (("", "GPL"), ("Lesser ", "LGPL"), ("Affero ", "AGPL")):
    for _v in {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}[_short]:
        _id = f"{_short}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES |= {f"{_id}-name": f"GNU {_kind}General Public License, version {_v}", f"{_id}-v": f"GNU {_kind}General Public License v{_v}"}
        TEMPLATES |= {f"{_id}-gnu": f"under the GNU {_short} v{_v}", f"{_id}-gnu-version": f"the GNU {_short} version {_v}"}
for _v in ("4.0", "3.0", "2.5", "2.0"):
    for _id, _words in (("BY-SA", "ShareAlike"), ("BY-NC", "NonCommercial"), ("BY-ND", "NoDerivatives"), ("BY-NC-SA", "NonCommercial-ShareAlike"), ("BY-NC-ND", "NonCommercial-NoDerivatives")):
        TEMPLATES |= {f"CC-{_id}-{_v}": f"CC {_id} {_v}", f"CC-{_id}-{_v}-name": f"Creative Commons Attribution-{_words} {_v}"}
    TEMPLATES |= {f"CC-BY-{_v}-name": f"Creative Commons Attribution {_v}"}
    TEMPLATES |= {f"CC-BY-{_v}-under{'-' * bool(a)}{a.strip()}": f"under {a}CC BY {_v}" for a in ("", "a ", "the ")}
# Ways to say under which license: with the verb, five words at least.
for _verb in ("Licensed", "Released", "Distributed", "Available", "Provided", "Published", "Covered"):
    for _id, _words in (
        ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0-short", "Apache License 2.0"), ("Apache-2.0-first", "Apache 2.0 License"), ("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD", "BSD License"),
        ("GPL-2.0", "GPL v2"), ("GPL-3.0", "GPL v3"), ("GPL-2.0-one", "GPLv2 license"), ("GPL-3.0-one", "GPLv3 license"), ("LGPL-3.0", "LGPL v3"), ("AGPL-3.0", "AGPL v3"),
    ):
        if f"{_verb} under the {_words}" not in TEMPLATES.values():
            TEMPLATES[f"{_id}-{_verb.lower()}"] = f"{_verb} under the {_words}"
TEMPLATES |= {"MIT-terms": "terms of the MIT License", "ISC-terms": "terms of the ISC License", "BSD-terms": "terms of the BSD License", "Apache-2.0-terms": "terms of the Apache License, Version 2.0"}
# Not in TEMPLATES: reported only without a more exact name that begins alike.
FAMILIES = {"GPL": "the GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License", "MPL": "of the Mozilla Public License"}
SPDX = r"SPDX-License-Identifier:[ \t]*([^\r\n]*)"


def _shingled(df: DataFrame, text: str) -> DataFrame:
    """Columns words and s, each a projection of its own: inside a lambda an inlined split would run for every element."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    df = df.withColumn("words", F.split(clean, " "))
    n = F.size("words") - SHINGLE + 1
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.col("words")[i + j] for j in range(SHINGLE))))
    return df.withColumn("s", F.when(n > 0, each).otherwise(F.array().cast("array<bigint>")))


def _bands(shingles, step: int):
    per = WIDTH - SHINGLE + 1
    last = F.size(shingles) - 1
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    # Each window as a struct of its shingles, so that the bands read fields and index no array again.
    windows = F.transform(starts, lambda i: F.struct(*(shingles[F.least(i + j, last)].alias(f"w{j}") for j in range(per))))

    def values(w):
        return F.array(*(F.least(*(w[f"w{j}"].bitwiseXOR(F.lit(m)) for j in range(per))) for m in MASKS))

    return F.when(F.size(shingles) > 0, F.flatten(F.transform(windows, values))).otherwise(F.array().cast("array<bigint>"))


def _literal(values, kind: str):
    """An array as a literal that is parsed once."""
    return F.expr(f"cast(array({', '.join(map(str, values))}) as array<{kind}>)")


def _spdx(text: str):
    """Identifiers of the text's SPDX lines; one expression may have several."""
    lines = F.concat_ws(" ", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPDX), F.lit(1)))
    ids = F.regexp_extract_all(lines, F.lit(r"([A-Za-z0-9][A-Za-z0-9.+:-]*)"), F.lit(1))
    return F.filter(ids, lambda x: ~F.upper(x).isin("AND", "OR", "WITH"))


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] = TEMPLATES, families: dict[str, str] = FAMILIES) -> DataFrame:
    """doc_id, n_licenses, licenses (names, sorted and joined by commas)."""
    if len(templates) + len(families) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    rows = [(n, False, b) for n, b in sorted(templates.items())] + [(n, True, b) for n, b in sorted(families.items())]
    frame = _shingled(spark.createDataFrame(rows, "name string, family boolean, body string"), "body")
    known = frame.select("name", "family", F.array_distinct("s").alias("s"), F.array_distinct(_bands(F.col("s"), 1)).alias("bands")).where(F.size("s") > 0).collect()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _shingled(docs.withColumn("spdx", F.when(F.instr("text", "SPDX-") > 0, _spdx("text"))), "text").select("doc_id", "spdx", "s")
    if known:
        of: dict[int, list[int]] = {}
        for k, r in enumerate(known):
            for band in r["bands"]:
                of.setdefault(band, []).append(k)
        out = out.withColumn("hit", F.filter(_bands(F.col("s"), STEP), lambda h: h.isin(list(of))))
        # Retrieved templates by their place in known; the document's shingles that some template has.
        by_band = F.map_from_arrays(_literal([f"{b}L" for b in of], "bigint"), F.expr("array(" + ", ".join(f"array({', '.join(map(str, ks))})" for ks in of.values()) + ")"))
        out = out.withColumn("retrieved", F.when(F.size("hit") > 0, F.array_distinct(F.flatten(F.transform(F.array_distinct("hit"), lambda h: by_band[h])))))
        out = out.withColumn("mine", F.when(F.size("hit") > 0, F.filter("s", lambda h: h.isin(sorted({x for r in known for x in r["s"]})))))
        body = F.expr("array(" + ", ".join(f"array({', '.join(f'{x}L' for x in r['s'])})" for r in known) + ")")
        need = _literal([f"{CONTAINMENT * len(r['s'])!r}D" for r in known], "double")
        names, family = F.array(*(F.lit(r["name"]) for r in known)), _literal([str(r["family"]).lower() for r in known], "boolean")
        out = out.withColumn("found", F.filter("retrieved", lambda k: F.size(F.array_intersect("mine", body[k])) >= need[k]))
        out = out.withColumn("names", F.transform(F.filter("found", lambda k: ~family[k]), lambda k: names[k]))
        out = out.withColumn("wide", F.transform(F.filter("found", lambda k: family[k]), lambda k: names[k]))
    else:
        out = out.withColumn("names", F.lit(None).cast("array<string>")).withColumn("wide", F.col("names"))
    none = F.array().cast("array<string>")
    out = out.select("doc_id", F.array_union(F.coalesce("names", none), F.coalesce("spdx", none)).alias("names"), F.coalesce("wide", none).alias("wide"))
    only = F.filter("wide", lambda w: ~F.exists("names", lambda n: F.startswith(n, w)))
    out = out.select("doc_id", F.array_sort(F.array_union("names", only)).alias("names"))
    return out.select("doc_id", F.size("names").cast("long").alias("n_licenses"), F.array_join("names", ",").alias("licenses"))


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))
