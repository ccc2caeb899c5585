"""More of the query catalogue: names and sidecars, geometry, labels and glyphs, tiles, and publishing."""

from __future__ import annotations



from pyspark.sql import functions as F

from parcelflow.functions import codes, rules
from parcelflow.functions import geometry as geo
from parcelflow.operators import labels, raster, select, topology
from parcelflow.sources import sheets

from .catalog import BASE, SEG_SQL, _t, coded, grid, parcels, query, segments

NAMES_SQL = """SELECT o_orderkey AS fid, 'in/' || CASE o_orderkey % 5 WHEN 0 THEN lpad((o_orderkey % 1000000)::VARCHAR, 7, '0') || '#13-55-0' || lpad((o_custkey % 100)::VARCHAR, 2, '0') || '-0000-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || '#x.tif'
WHEN 1 THEN '000#13-55-010-0000-0234' WHEN 2 THEN '064286#13-55-010-0000-0234.tif' WHEN 3 THEN o_orderkey::VARCHAR || '#13-55-10-0000-0234#' ELSE '' END AS path FROM orders"""


def names(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lpad((k % 1000000).cast("string"), 7, "0"), F.lit("#13-55-0"), F.lpad((c % 100).cast("string"), 2, "0"), F.lit("-0000-"), F.lpad((c % 10000).cast("string"), 4, "0"), F.lit("#x.tif"))
    name = F.when(k % 5 == 0, text).when(k % 5 == 1, "000#13-55-010-0000-0234").when(k % 5 == 2, "064286#13-55-010-0000-0234.tif").when(k % 5 == 3, F.concat(k.cast("string"), F.lit("#13-55-10-0000-0234#"))).otherwise("")
    return _t(spark, d, "orders").select(k.alias("fid"), F.concat(F.lit("in/"), name).alias("path"))


@query(f"""WITH n AS ({NAMES_SQL}), e AS (SELECT fid, regexp_extract(path, '^in/([0-9]+)#([0-9]{{2}})-([0-9]{{2}})-([0-9]{{3}})-([0-9]{{4}})-([0-9]{{4}})(#|$)', ['nmp', 'dep', 'mun', 'sec', 'chac', 'mz', 'z']) AS m FROM n)
SELECT fid, CASE WHEN m.dep = '' THEN NULL WHEN ltrim(m.nmp, '0') = '' THEN '0' ELSE ltrim(m.nmp, '0') END AS nmp, nullif(m.dep, '') AS dep, nullif(m.mun, '') AS mun, nullif(m.sec, '') AS sec, nullif(m.chac, '') AS chac, nullif(m.mz, '') AS mz FROM e""")
def q_file_names(spark, d):
    parts = rules.file_parts(F.element_at(F.split("path", "/"), -1))
    return names(spark, d).select("fid", *(c.alias(k) for k, c in parts.items()))


SIDE_SQL = "s AS (SELECT fid, CASE WHEN fid % 3 = 0 THEN (fid % 50)::VARCHAR END AS sec, CASE WHEN fid % 6 = 0 THEN '9' END AS mz FROM n)"


@query(f"""WITH n AS ({NAMES_SQL}), {SIDE_SQL}, e AS (SELECT fid, regexp_extract(path, '^in/([0-9]+)#([0-9]{{2}})-([0-9]{{2}})-([0-9]{{3}})-([0-9]{{4}})-([0-9]{{4}})(#|$)', ['nmp', 'dep', 'mun', 'sec', 'chac', 'mz', 'z']) AS m FROM n)
SELECT fid, CASE WHEN s.sec IS NULL THEN nullif(m.dep, '') END AS dep, CASE WHEN s.sec IS NULL THEN nullif(m.sec, '') ELSE s.sec END AS sec, CASE WHEN s.sec IS NULL THEN nullif(m.mz, '') ELSE s.mz END AS mz FROM e JOIN s USING (fid)""")
def q_metadata(spark, d):
    n = names(spark, d)
    parts = sheets.from_names(n.withColumn("path", F.concat(F.col("fid").cast("string"), F.lit("/"), F.element_at(F.split("path", "/"), -1))))
    side = n.where("fid % 3 = 0").select(F.concat(F.col("fid").cast("string"), F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("path"), *(
        {"sec": (F.col("fid") % 50).cast("string"), "mz": F.when(F.col("fid") % 6 == 0, "9")}.get(k, F.lit(None).cast("string")).alias(k) for k in rules.META))
    return sheets.preferred(parts, side).select(F.split("path", "/")[0].cast("long").alias("fid"), "dep", "sec", "mz")


@query(BASE + """, k AS (SELECT fid, raw_no AS label, regexp_full_match(raw_no, '[0-9]+[A-Za-zÑñ]?') AS num, o.o_custkey AS sheet FROM p2 JOIN orders o ON fid = o_orderkey),
l AS (SELECT sheet, label, row_number() OVER (PARTITION BY sheet ORDER BY NOT num, CASE WHEN num THEN regexp_extract(label, '^[0-9]+')::BIGINT ELSE 0 END, CASE WHEN num THEN upper(regexp_replace(label, '^[0-9]+', '')) ELSE upper(label) END, label) AS pos FROM k WHERE label <> ''),
g AS (SELECT sheet, fid, row_number() OVER (PARTITION BY sheet ORDER BY fid) AS pos FROM k)
SELECT sheet, fid AS poly_idx, coalesce(label, '') AS label FROM g LEFT JOIN l USING (sheet, pos)""")
def q_natural_order(spark, d):
    p = parcels(spark, d).select("fid", "raw_no").join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("fid"), F.col("o_custkey").alias("sheet")), "fid")
    named = p.where("raw_no <> ''").select("sheet", F.col("raw_no").alias("label"))
    return labels.in_order(p.select("sheet", F.col("fid").alias("poly_idx"), F.col("fid").alias("rank")), named, "sheet")


@query("""WITH r AS (SELECT o_custkey AS sheet, round(o_totalprice * 100)::BIGINT AS area, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT sheet, (count(*) >= 3)::INT AS reached, sum(area)::BIGINT AS area FROM r WHERE k <= 3 GROUP BY 1""")
def q_expected_count(spark, d):
    f = _t(spark, d, "orders").select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("fid"), F.round(F.col("o_totalprice") * 100).cast("long").alias("area"))
    return select.expected_count(f, "sheet", 3)


@query(f"""WITH {SEG_SQL} SELECT l_orderkey, l_linenumber, round(1000 + 0.5::DOUBLE * (c0 + 7) + 0.1::DOUBLE * (r0 + 3), 6) AS x, round(2000 + 0.1::DOUBLE * (c0 + 7) - 0.5::DOUBLE * (r0 + 3), 6) AS y, (c0 + 7)::DOUBLE AS c, (r0 + 3)::DOUBLE AS r FROM s""")
def q_affine_rotated(spark, d):
    g = geo.geotransform(1000, 0.5, 0.1, 2000, 0.1, -0.5)
    line = geo.line_to_world(F.array(F.struct(F.col("c0").alias("c"), F.col("r0").alias("r"))), g, F.lit(7), F.lit(3))
    s = segments(spark, d).withColumn("p", line[0])
    c, r = geo.to_pixel(F.col("p.x"), F.col("p.y"), g)
    return s.select("l_orderkey", "l_linenumber", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), (F.round(c, 6) + 0.0).alias("c"), (F.round(r, 6) + 0.0).alias("r"))


@query(f"""WITH {SEG_SQL} SELECT l_orderkey, count(*) AS n, sum((c1 - c0) * (r1 - r0))::DOUBLE AS signed, max(abs((c1 - c0) * (r1 - r0)))::DOUBLE AS largest, count_if((c1 - c0) * (r1 - r0) <> 0) AS n_closed,
count_if(abs((c1 - c0) * (r1 - r0)) >= 400) AS n_kept, sum(2 * (abs(c1 - c0) + abs(r1 - r0)) * ((c1 - c0) * (r1 - r0) <> 0)::INT)::DOUBLE AS around FROM s GROUP BY 1""")
def q_rings(spark, d):
    at = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = segments(spark, d).withColumn("ring", F.array(at("c0", "r0"), at("c1", "r0"), at("c1", "r1"), at("c0", "r1")))
    g, ring = geo.geotransform(0, 0.5, 0, 0, 0, -0.5), F.col("ring")
    s = s.select("l_orderkey", geo.signed_area(ring).alias("signed"), geo.area(ring).alias("area"), geo.closed(ring).alias("closed"), geo.least_area(F.lit(4.0), g).alias("least"))
    return s.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), (F.sum("signed") + 0.0).alias("signed"), F.coalesce(F.max("area"), F.lit(0.0)).alias("largest"), F.count("closed").alias("n_closed"),
        F.count_if(F.col("area") >= F.col("least")).alias("n_kept"), F.sum(F.coalesce(geo.length(F.col("closed")), F.lit(0.0))).alias("around"))


@query(f"""WITH {SEG_SQL}, l AS (SELECT *, sqrt(((c1-c0)*(c1-c0)+(r1-r0)*(r1-r0))::DOUBLE) AS n FROM s) SELECT l_orderkey, l_linenumber, round_even(c0 - (c1-c0) / n * 32, 0) + 0.0 AS c0, round_even(r0 - (r1-r0) / n * 32, 0) + 0.0 AS r0,
round_even(c1 + (c1-c0) / n * 32, 0) + 0.0 AS c1, round_even(r1 + (r1-r0) / n * 32, 0) + 0.0 AS r1 FROM l WHERE n >= 1""")
def q_extended(spark, d):
    ends = geo.extended(*(F.col(c) for c in ("c0", "r0", "c1", "r1")), F.lit(4.0))
    return segments(spark, d).select("l_orderkey", "l_linenumber", *((e + 0.0).alias(c) for e, c in zip(ends, ("c0", "r0", "c1", "r1"), strict=True))).where("c0 is not null")


def sheet_lines(spark, d):
    return segments(spark, d).select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("i"), "c0", "r0", "c1", "r1")


@query(f"""WITH {SEG_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS k FROM s), p AS (SELECT a.l_orderkey AS sheet, a.l_linenumber AS i, b.l_linenumber AS j,
((a.c0-a.c1)*(b.r0-b.r1) - (a.r0-a.r1)*(b.c0-b.c1))::DOUBLE AS den, (a.c0*a.r1-a.r0*a.c1)*(b.c0-b.c1) - (a.c0-a.c1)*(b.c0*b.r1-b.r0*b.c1) AS nx, (a.c0*a.r1-a.r0*a.c1)*(b.r0-b.r1) - (a.r0-a.r1)*(b.c0*b.r1-b.r0*b.c1) AS ny
FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.k >= 3)
SELECT sheet, i, j, nx / den + 0.0 AS x, ny / den + 0.0 AS y FROM p WHERE abs(den) >= 1e-6 AND nx / den BETWEEN -12.5 AND 262.5 AND ny / den BETWEEN -12.5 AND 112.5""")
def q_intersections(spark, d):
    out = topology.intersections(sheet_lines(spark, d), 250, 100)
    return out.select("sheet", "i", "j", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))


@query("""WITH g AS (SELECT DISTINCT l_orderkey, l_linenumber % 2 AS ori, l_quantity::INT AS pos FROM lineitem) SELECT a.l_orderkey AS sheet, a.pos AS x, b.pos AS y FROM g a JOIN g b ON a.l_orderkey = b.l_orderkey AND a.ori = 1 AND b.ori = 0""")
def q_node_points(spark, d):
    return topology.nodes(grid(spark, d)).select("sheet", "x", "y")


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS sheet, l_linenumber % 2 AS ori, l_quantity::INT AS pos FROM lineitem),
n AS (SELECT sheet, count_if(ori = 1) AS v, count_if(ori = 0) AS h, max(pos) FILTER (WHERE ori = 1) - min(pos) FILTER (WHERE ori = 1) AS w, max(pos) FILTER (WHERE ori = 0) - min(pos) FILTER (WHERE ori = 0) AS t FROM g GROUP BY 1)
SELECT sheet, v * (h - 1) + h * (v - 1) - 2 * (v + h - 2) AS n_shared, 2 * (v + h - 2) AS n_outer, 2 * (w + t) AS perimeter FROM n WHERE v > 1 AND h > 1""")
def q_block_edges(spark, d):
    return topology.outlines(topology.edge_uses(topology.cells(grid(spark, d))))


@query("")
def q_collinear(spark, d):
    return topology.merge_collinear(sheet_lines(spark, d).drop("i"), 4.0)


@query("")
def q_dominant_lines(spark, d):
    return topology.dominant_lines(sheet_lines(spark, d).drop("i"), 4.0, 24)


@query("")
def q_support_chains(spark, d):
    return topology.support_chains(topology.intersections(sheet_lines(spark, d), 250, 100), 250, 100)


@query("""WITH l AS (SELECT DISTINCT l_partkey % 72 * 5 - 180 AS prior FROM lineitem), h AS (SELECT prior, unnest([0, 180]) AS turn FROM l), s AS (SELECT prior, turn, unnest([0, -5, 5, -10, 10]) AS step FROM h)
SELECT DISTINCT prior::BIGINT AS prior, (((prior + turn + step + 180) % 360 + 360) % 360 - 180)::DOUBLE AS angle FROM s""")
def q_sweep_angles(spark, d):
    p = _t(spark, d, "lineitem").select((F.col("l_partkey") % 72 * 5 - 180).alias("prior")).distinct()
    return p.select("prior", F.explode(rules.sweep(F.col("prior").cast("double"))).alias("angle"))


@query("""WITH w AS (SELECT event_id, [6, 10, 12, 14, 16][event_id % 5 + 1] AS a FROM events) SELECT event_id, a AS auto, CASE a WHEN 6 THEN '6,4' WHEN 10 THEN '10,6,4' WHEN 12 THEN '12,7,5,4' WHEN 14 THEN '14,8,6,4' ELSE '16,10,6,4' END AS tried FROM w""")
def q_width_candidates(spark, d):
    a = F.array(*(F.lit(v) for v in (6, 10, 12, 14, 16)))[(F.col("event_id") % 5).cast("int")]
    return _t(spark, d, "events").select("event_id", a.alias("auto"), F.array_join(rules.widths(a).cast("array<string>"), ",").alias("tried"))


@query(f"""WITH {SEG_SQL} SELECT l_orderkey, l_linenumber, greatest(0, least(c0, c1) - 10) AS col0, greatest(0, least(r0, r1) - 10) AS row0, least(220, greatest(c0, c1) + 11) AS col1, least(95, greatest(r0, r1) + 11) AS row1 FROM s
WHERE least(220, greatest(c0, c1) + 11) > greatest(0, least(c0, c1) - 10) AND least(95, greatest(r0, r1) + 11) > greatest(0, least(r0, r1) - 10)""")
def q_roi(spark, d):
    box = geo.clamped_box(*(F.col(c) for c in ("c0", "r0", "c1", "r1")), F.lit(220), F.lit(95), F.lit(10))
    return segments(spark, d).select("l_orderkey", "l_linenumber", box.alias("b")).where("b is not null").select("l_orderkey", "l_linenumber", "b.*")


@query("""SELECT l_orderkey // 4 AS poly_idx, l_partkey % 30 AS label, min(l_extendedprice * CASE WHEN l_quantity - 25 < 0 THEN 1.3 ELSE 1 + 0.3 * exp(-(l_quantity - 25) / 100) END) AS cost FROM lineitem GROUP BY 1, 2""".replace("min(", "round(min(").replace("END) AS cost", "END), 4) AS cost"))
def q_ownership_cost(spark, d):
    li = _t(spark, d, "lineitem")
    return li.groupBy(F.floor(F.col("l_orderkey") / 4).alias("poly_idx"), (F.col("l_partkey") % 30).alias("label")).agg(F.round(F.min(F.col("l_extendedprice") * rules.ownership(F.col("l_quantity") - 25)), 4).alias("cost"))


def cost_table(spark, d):
    li = _t(spark, d, "lineitem")
    return li.groupBy(F.floor(F.col("l_orderkey") / 64).alias("sheet"), F.floor(F.col("l_orderkey") / 8).alias("poly_idx"), F.lpad((F.col("l_suppkey") % 12).cast("string"), 3, "0").alias("label")).agg(F.min(F.col("l_extendedprice") / 10).alias("cost"))


@query("")
def q_hungarian(spark, d):
    costs = cost_table(spark, d)
    return select.decisive(labels.assigned(costs), costs)


GRID_SQL = "g AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor((e::DOUBLE + 1) * 127.5)) AS v FROM embeddings)"


def tiles(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("double")).alias("v"))


@query(f"""WITH {GRID_SQL}, t AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x, label FROM g), m AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([0, 2, -2, 0, 0]) AS dr, unnest([0, 0, 0, 2, -2]) AS dc),
q AS (SELECT vec_id, k, ((i // 8 + dr + 8) % 8) * 8 + (i % 8 + dc + 8) % 8 AS i, x FROM t CROSS JOIN m), l AS (SELECT vec_id AS s, label, i, x AS y FROM t WHERE vec_id < 20),
e AS (SELECT vec_id, k, s, label, sum((x - y) * (x - y)) / 64 AS dist FROM q JOIN l USING (i) GROUP BY ALL), n AS (SELECT vec_id, label, min(dist) AS dist FROM e GROUP BY ALL)
SELECT vec_id AS marker, min_by(label::VARCHAR, (dist, label)) AS text, round(min(dist), 4) AS score FROM n GROUP BY 1""")
def q_glyph_nn(spark, d):
    t = tiles(spark, d)
    library = t.where("vec_id < 20").select(F.col("label").cast("string").alias("char"), "v")
    near = labels.char_distances(t.select(F.col("vec_id").alias("glyph"), "v"), library, 8, 8)
    row = labels.read_row(near.select(F.col("glyph").alias("marker"), F.lit(0).alias("pos"), F.lit(True).alias("last"), "char", "dist"))
    return row.select("marker", "text", F.round("score", 4).alias("score"))


@query("""WITH e AS (SELECT vec_id, m, unnest(list_transform(embedding[10 * m + 1 : 10 * m + 10], lambda x: x::DOUBLE)) AS x, unnest(range(10)) AS c FROM embeddings, (SELECT unnest([0, 1, 2, 3, 4]) AS m)),
p AS (SELECT vec_id, c, avg(w) AS p FROM (SELECT vec_id, m, c, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id, m) AS w FROM e) GROUP BY 1, 2)
SELECT vec_id, max_by(c, p)::VARCHAR AS "char", round(max(p), 6) AS conf FROM p GROUP BY 1""")
def q_softmax_ensemble(spark, d):
    members = F.array(*(F.transform(F.slice("embedding", 10 * m + 1, 10), lambda x: x.cast("double")) for m in range(5)))
    e = _t(spark, d, "embeddings").select("vec_id", labels.ensemble(members).alias("logits"))
    got = labels.classified(F.col("logits"), F.array(*(F.lit(str(c)) for c in range(10))), F.lit(True))
    return e.select("vec_id", got.alias("g")).select("vec_id", "g.char", F.round("g.conf", 6).alias("conf"))


@query(f"""WITH {GRID_SQL}, c AS (SELECT label AS tile, x AS v, count(*) AS n FROM (SELECT label, unnest(v)::BIGINT AS x FROM g) GROUP BY 1, 2),
w AS (SELECT tile, v, sum(n) OVER k AS w, sum(n * v) OVER k AS s, sum(n) OVER (PARTITION BY tile) AS n, sum(n * v) OVER (PARTITION BY tile) AS t FROM c WINDOW k AS (PARTITION BY tile ORDER BY v)),
b AS (SELECT tile, v, CASE WHEN w < n THEN (t * w - n * s)::DOUBLE * (t * w - n * s)::DOUBLE / (w * (n - w))::DOUBLE ELSE 0 END AS b FROM w)
SELECT tile, arg_min(v, v)::BIGINT AS threshold FROM b x WHERE b = (SELECT max(b) FROM b y WHERE y.tile = x.tile) GROUP BY 1""")
def q_otsu(spark, d):
    px = tiles(spark, d).select(F.col("label").alias("tile"), F.explode(F.col("v").cast("array<bigint>")).alias("v"))
    return raster.otsu(px).select("tile", F.col("threshold").cast("long").alias("threshold"))


@query(f"""WITH RECURSIVE {GRID_SQL}, i AS (SELECT vec_id, i // 8 AS r, i % 8 AS c FROM (SELECT vec_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM g) WHERE x <= 112),
reach AS (SELECT vec_id, r * 8 + c AS root, r, c FROM i UNION SELECT i.vec_id, least(reach.root, i.r * 8 + i.c), i.r, i.c FROM reach JOIN i ON i.vec_id = reach.vec_id AND abs(i.r - reach.r) <= 1 AND abs(i.c - reach.c) <= 1),
o AS (SELECT vec_id, r, c, min(root) AS comp FROM reach GROUP BY 1, 2, 3), k AS (SELECT vec_id AS tile, comp, count(*) AS n, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM o GROUP BY 1, 2)
SELECT tile, comp::BIGINT AS comp, n, h, w FROM k WHERE greatest(h, w) >= 4 OR n / (h * w) < 0.2""")
def q_components(spark, d):
    t = tiles(spark, d).select(F.col("vec_id").alias("tile"), F.transform("v", lambda x: x <= 112).alias("ink"))
    return raster.strokes(raster.components(t, 8, 8), 0.5)


@query(BASE + """, e AS (SELECT block, fid, number, CASE WHEN block = '' THEN '' WHEN length(number) BETWEEN 1 AND 4 THEN block || number WHEN number = '' THEN block ELSE '' END AS code,
CASE WHEN number <> '' AND NOT ok THEN 'number,' ELSE '' END || CASE WHEN regexp_full_match(mz, '[0-9]{1,4}') THEN '' ELSE 'mz,' END AS faults, raw_no FROM p2)
SELECT fid, code, rtrim(faults, ',') AS faults, CASE WHEN regexp_full_match(mz, '[0-9]{1,4}') THEN lpad(mz, 4, '0') ELSE '' END AS mz, 'unknown_' || e.number || '.png' AS file FROM e JOIN p2 USING (fid)""")
def q_review_gate(spark, d):
    p = coded(parcels(spark, d))
    return p.select("fid", rules.feature_code(F.col("block"), F.col("number")).alias("code"), F.array_join(rules.review_faults(F.col("number"), F.col("sec"), F.col("mz")), ",").alias("faults"), rules.padded("mz", F.col("mz")).alias("mz"), rules.crop_name(F.lit(" "), F.col("number")).alias("file"))


@query(BASE + """, r AS (SELECT fid, CASE WHEN block = '' THEN '' WHEN length(number) BETWEEN 1 AND 4 THEN substr(block, 1, 4) || '0050000' || '0007' || number ELSE '' END AS cca, number, ok AND reviewed AS fine FROM p2 WHERE fid % 13 <> 0),
l AS (SELECT fid, cca, number, (cca <> '' AND fine) AS ready, fid % 7 AS layer FROM r)
SELECT layer, fid, cca, number FROM l WHERE ready AND layer IN (1, 4) AND fid % 5 <> 0 AND length(cca) = 19 AND fid NOT IN (SELECT fid FROM l WHERE NOT ready)""")
def q_publish_records(spark, d):
    p = coded(parcels(spark, d))
    rows = p.select("fid", F.col("block").alias("cca"), F.col("raw_no").alias("number"), F.lit("5").alias("sec"), F.lit("7").alias("mz"), "reviewed", (F.col("fid") % 13 != 0).alias("has_geometry"), (F.col("fid") % 7).alias("layer"))
    r = sheets.parcel_records(rows).where("ready")
    return sheets.publishable(*(r.where(F.col("layer") == k) for k in (1, 4))).where("fid % 5 <> 0").select("layer", "fid", "cca", "number")


@query(BASE + """, b AS (SELECT DISTINCT block, mz FROM p2) SELECT mz, block AS cca, substr(block, 12, 4) AS number, block <> '' AS ready FROM b""")
def q_block_records(spark, d):
    p = parcels(spark, d)
    return sheets.block_records(p.select(*(k for k, _ in codes.PARTS), F.lit(True).alias("has_geometry"))).select("mz", "cca", "number", "ready").distinct()


@query("")
def q_reading_order(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("poly_idx"), (F.col("o_orderkey") % 101).alias("x"), (F.col("o_totalprice") % 97).alias("y"))
    return labels.reading_order(o)


@query("""WITH o AS (SELECT o_custkey AS sheet, o_orderkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT sheet, p AS poly_idx, k - 1 AS rank FROM o WHERE n >= 3""")
def q_chain_order(spark, d):
    from pyspark.sql import Window

    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("poly_idx"))
    w = Window.partitionBy("sheet").orderBy("poly_idx")
    edges = o.withColumn("b", F.lead("poly_idx").over(w)).where("b is not null").select("sheet", F.col("poly_idx").alias("a"), "b")
    return labels.chain_order(edges, o.withColumn("x", F.lit(0.0)).withColumn("y", -F.col("poly_idx").cast("double")))
