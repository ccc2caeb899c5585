"""Worked examples and brute force for operators that SQL doesn't cover, with nulls, blanks and ties."""

import itertools

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import codes, rules
from parcelflow.functions import geometry as geo
from parcelflow.operators import labels, raster, select, topology
from parcelflow.sources import sheets


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def one(spark, values, f, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in frame.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_numbers(spark):
    given = ["", "18", "165a", " 7 ", "0000", "000A", "3ñ", "A001", "01A2", "12345", "-5", " 7\x1f", None]
    assert one(spark, given, codes.normalized) == ["", "0018", "165A", "0007", "0000", "000A", "003Ñ", "A001", "01A2", "12345", "-005", "0007", ""]
    assert one(spark, given, codes.valid) == [False, True, True, True, False, False, True, False, False, False, False, True, False]
    parts = {"dep": "13", "mun": "55", "sec": "10", "chac": "0", "mz": "234"}
    block = lambda **k: codes.block_code({n: F.lit(v) for n, v in {**parts, **k}.items()})
    row = spark.range(1).select(block().alias("a"), block(dep="").alias("b"), block(dep="123").alias("c"), block(sec="1x").alias("d"), codes.parcel_code(block(), F.lit("18")).alias("e"), codes.parcel_code(block(), F.lit("000A")).alias("f"), codes.parcel_code(block(), F.lit("12345")).alias("g"), rules.feature_code(block(), F.lit(" ")).alias("h")).first()
    assert tuple(row) == ("135501000000234", "", "", "", "1355010000002340018", "135501000000234000A", "", "135501000000234")
    assert one(spark, ["0004", "003A", "0000", "0120", "1234", "18", "003Ñ"], rules.display_forms) == [["4", "04", "0004"], ["3A", "03A", "003A"], ["0", "00", "0000"], ["120", "0120"], ["1234"], ["18"], ["3Ñ", "03Ñ", "003Ñ"]]


def test_names(spark):
    got = one(spark, ["064286#13-55-010-0000-0234#x.tif", "000#13-55-010-0000-0234", "064286#13-55-010-0000-0234.tif", "", None], lambda v: F.concat_ws("/", *rules.file_parts(v).values()))
    assert got == ["64286/13/55/010/0000/0234", "0/13/55/010/0000/0234", "", "", ""]
    assert one(spark, ["2, 3a,, ", None], rules.label_list) == [["2", "3a"], []]
    order = [r.v for r in spark.createDataFrame([(v,) for v in ("10", "2", "2B", "2A", "X1", "003")], "v string").orderBy(rules.natural_key(F.col("v"))).collect()]
    assert order == ["2", "2A", "2B", "003", "10", "X1"]


def test_weights(spark):
    assert one(spark, [0.0], rules.sweep, "double")[0] == [0, -5, 5, -10, 10, -180, 175, -175, 170, -170]
    assert one(spark, [None], rules.sweep, "double")[0] == list(range(-45, 50, 5))
    assert [round(x, 6) for x in one(spark, [-1.0, 0.0, 100.0], rules.ownership, "double")] == [1.3, 1.3, 1.110364]
    assert one(spark, [1, 2, 3, 5], rules.stroke_width, "int") == [6, 10, 14, 16]
    pairs = spark.createDataFrame([("12", "13"), ("12", "12"), ("12", "21"), ("12", "123"), ("12", "312"), ("12", "132")], "a string, b string")
    assert [r[0] for r in pairs.select(rules.siblings(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, True, False]


def test_width(spark):
    rows = [(1, 14, 0.58, True), (1, 4, 0.77, True), (2, 10, 0.49, True), (2, 4, 0.86, True), (3, 10, 0.50, True), (3, 4, 0.94, True), (4, 16, 0.30, True), (4, 10, 0.20, True), (5, 16, 0.9, False), (5, 4, 0.1, True), (6, 16, 0.0, False), (6, 4, 0.0, False)]
    frame = spark.createDataFrame([(s, r, w, c, f) for s, w, c, f in rows for r in (0, 1)], "sheet int, recover int, stroke_px int, cov double, has_faces boolean")
    got = {(r.sheet, r.recover): r.stroke_px for r in select.width(frame).collect()}
    assert [got[s, 0] for s in range(1, 7)] == [14, 4, 4, 16, 4, 16] and [got[s, 1] for s in range(1, 7)] == [4, 4, 4, 16, 4, 16]


def test_consensus(spark):
    rows = [(1, 1, a, "0011", 0.85) for a in range(4)] + [(1, 1, 9, "0110", 0.94)] + [(1, 2, a, "0011", 0.95) for a in range(4)] + [(1, 2, 9, "0110", 0.97)] + [(2, 1, a, "0011", 0.95) for a in range(4)] + [(2, 1, 9, "0110", 0.6), (3, 1, 0, "-", 0.9), (3, 1, 0, None, 0.9)]
    got = {(r.poly_idx, r.marker_id): (r.text, r.n_angles, r.conf) for r in select.consensus(spark.createDataFrame(rows, "poly_idx int, marker_id int, angle int, text string, min_conf double")).collect()}
    assert got == {(1, 1): ("0011", 4, 0.85), (1, 2): ("0011", 4, 0.899999), (2, 1): ("0011", 4, 0.95)}


def test_hungarian():
    rng = np.random.default_rng(0)
    for h, w in itertools.product(range(1, 6), repeat=2):
        for _ in range(5):
            c = rng.integers(0, 12, (h, w)).astype(float)
            pairs = labels.hungarian(c)
            k = min(h, w)
            best = min(sum(c[r, q] for r, q in zip(rs, qs, strict=True)) for rs in itertools.combinations(range(h), k) for qs in itertools.permutations(range(w), k))
            assert len(pairs) == k and len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == k and sum(c[p] for p in pairs) == best


def test_merged(spark):
    rows = [(1, 0, "1", "2", True, ["1", "2", "3"]), (1, 1, "2", None, False, ["1", "2", "3"]), (1, 2, "1", None, False, ["1", "2", "3"]), (1, 3, None, "9", False, ["1", "2", "3"]), (2, 0, None, None, False, None)]
    got = labels.merged(spark.createDataFrame(rows, "sheet long, poly_idx long, spatial string, read string, sure boolean, typed array<string>")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "2"), (1, 1, "1"), (1, 2, "3"), (1, 3, ""), (2, 0, "")]


def test_orders(spark):
    square = [(1, 3 * r + c, 10.0 * c, -10.0 * r) for r in range(3) for c in range(3)]
    strip = [(2, k, float(k), 0.01 * k) for k in range(5)]
    got = sorted(map(tuple, labels.reading_order(spark.createDataFrame([*square, *strip, (3, 7, 1.0, 1.0)], "sheet long, poly_idx long, x double, y double")).collect()))
    assert sorted(r for s, _, r in got if s == 1) == list(range(9)) and [r for s, _, r in got if s == 2] in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0]) and (3, 7, 0) in got
    edges = [(1, 10, 20), (1, 20, 30), (2, 1, 2), (2, 2, 3), (2, 3, 1), (3, 1, 2)]
    points = [(1, p, 0.0, float(p)) for p in (10, 20, 30)] + [(2, p, 0.0, 0.0) for p in (1, 2, 3)] + [(3, p, 0.0, 0.0) for p in (1, 2)]
    got = labels.chain_order(spark.createDataFrame(edges, "sheet long, a long, b long"), spark.createDataFrame(points, "sheet long, poly_idx long, x double, y double")).collect()
    assert sorted(map(tuple, got)) == [(1, 10, 2), (1, 20, 1), (1, 30, 0)]


def test_lines(spark):
    seg = [(1, 0, 0, 100, 0), (1, 10, 2, 60, 2), (1, 0, 50, 0, 150), (1, 5, 5, 5, 5), (2, 0, 0, 0, 0)]
    frame = spark.createDataFrame(seg, "sheet long, c0 long, r0 long, c1 long, r1 long")
    got = sorted(map(tuple, topology.merge_collinear(frame, 4.0).collect()))
    assert got == [(1, 0, 1, 100, 1), (1, 0, 50, 0, 150)] or got == [(1, 0, 50, 0, 150), (1, 0, 1, 100, 1)]
    assert sorted(map(tuple, topology.dominant_lines(frame, 4.0, 24).collect())) == [(1, 0, 0, 100, 0), (1, 0, 50, 0, 150)]
    assert topology.dominant_lines(frame, 4.0, 1).count() == 1 and topology.merge_collinear(frame.limit(0), 4.0).count() == 0


def test_components(spark):
    ink = np.zeros((4, 5), bool)
    ink[0, 0] = ink[1, 1] = ink[3, 3] = ink[3, 4] = True
    frame = spark.createDataFrame([(1, ink.ravel().tolist()), (2, [False] * 20), (3, [True] * 20)], "tile long, ink array<boolean>")
    assert sorted(map(tuple, raster.components(frame, 4, 5).collect())) == [(1, 0, 2, 2, 2), (1, 18, 2, 1, 2), (3, 0, 20, 4, 5)]
    assert raster.components(frame, 4, 5, corners=False).where("tile = 1").count() == 3
    areas = spark.createDataFrame([(1, r, a) for r, a in enumerate((1000, 950, 500, 380, 379))] + [(2, 0, 0), (2, 1, 0)], "sheet int, radius int, area int")
    assert {r.sheet: r.stroke_px for r in raster.line_width(areas).collect()} == {1: 14, 2: 12}


def test_publish(spark, tmp_path):
    kind = "cca string, number string, sec string, mz string, reviewed boolean, has_geometry boolean, nmp string, area double"
    good, bad = ("1355010000002340018", "18", "3", "7", True, True, "9", 2.345), ("135501000000234", "000A", "3", "7", True, True, "9", 1.0)
    layer = lambda *rows: sheets.parcel_records(spark.createDataFrame(rows, kind))
    where = f"{tmp_path}/out"
    assert sheets.append(sheets.publishable(layer(good), layer(good, bad)), where, "2024-05-06 07:08:09", ["cca"]) == 0
    for _ in range(2):
        assert sheets.append(sheets.publishable(layer(good), layer(good, (*good[:4], True, False, " ", 1.0))), where, "2024-05-06 07:08:09", ["cca", "etiqueta", "ara", "fecha", "nmp"]) == 2
    got = spark.read.parquet(where)
    assert got.count() == 4 and set(map(tuple, got.collect())) == {("1355003000000070018", "0018", 2.34, "2024-05-06", "9")}


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.tif.meta.json").write_text('{"nmp": " 5 ", "sec": ""}')
    (tmp_path / "b.tif.meta.json").write_text("not json")
    found = sheets.read_sidecars(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.nmp, r.sec) for r in found.collect()}
    assert got == {"a.tif": ("5", None), "b.tif": (None, None)}
    root = found.first().path.rsplit("/", 1)[0]
    named = sheets.from_names(spark.createDataFrame([(f"{root}/{n}",) for n in ("a.tif", "b.tif", "064#13-55-010-0000-0234#")], "path string"))
    assert sorted((r.nmp or "", r.dep or "") for r in sheets.preferred(named, found).collect()) == [("", ""), ("5", ""), ("64", "13")]
    assert sheets.save_sidecars(sheets.preferred(named, found), f"{tmp_path}/saved") == 2


def test_geometry(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]
    frame = spark.createDataFrame([(1, ring), (2, ring[:2]), (3, []), (4, [*ring, ring[0]])], "k int, ring array<struct<x:double,y:double>>")
    got = {r.k: (r.a, r.s, r.n) for r in frame.select("k", geo.area(F.col("ring")).alias("a"), geo.signed_area(F.col("ring")).alias("s"), F.size(geo.closed(F.col("ring"))).alias("n")).collect()}
    assert got[1] == (6, 6, 4) and got[2][0] == 0 and got[3][0] == 0 and got[4][:2] == (6, 6)


def test_extended(spark):
    """Ends that coincide give null, as do ends that are null; a pixel of length is enough."""
    given = [(5, 7, 5, 7), (10, 10, 11, 10), (0, 0, 30, 40), (4, 9, 4, 2), (None, 0, 3, 4)]
    frame = spark.createDataFrame([(k, *v) for k, v in enumerate(given)], "k int, c0 long, r0 long, c1 long, r1 long")
    ends = geo.extended(*(F.col(c) for c in ("c0", "r0", "c1", "r1")), F.lit(4.0))
    got = [tuple(r)[1:] for r in frame.select("k", *ends).orderBy("k").collect()]
    assert got == [(None,) * 4, (-22, 10, 43, 10), (-19, -26, 49, 66), (4, 41, 4, -30), (None,) * 4]
