"""Query catalogue: name to query, and to DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import codes, rules
from parcelflow.functions import geometry as geo
from parcelflow.operators import select, topology

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def parcels(spark, d):
    o, c, n = _t(spark, d, "orders"), _t(spark, d, "customer"), _t(spark, d, "nation")
    raw = F.expr("""CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '000A' WHEN 2 THEN concat(o_orderkey % 1000, 'a')
        WHEN 3 THEN '12345' ELSE cast(o_orderkey % 10000 AS string) END""")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.col("o_orderkey").alias("fid"), (F.col("n_regionkey") + 1).alias("dep"), F.col("c_nationkey").alias("mun"), (F.col("o_custkey") % 12).alias("sec"), F.lit("0").alias("chac"),
        F.when(F.col("o_orderkey") % 17 == 0, "").otherwise((F.col("o_custkey") % 10000).cast("string")).alias("mz"),
        raw.alias("raw_no"), (F.col("o_orderkey") % 5 != 0).alias("reviewed"), F.round(F.col("o_totalprice") * 100).cast("long").alias("area_c"))


def coded(p):
    block = codes.block_code({k: F.col(k) for k, _ in codes.PARTS})
    p = p.withColumn("block", block).withColumn("number", codes.normalized(F.col("raw_no")))
    p = p.withColumn("cca", codes.code_of(F.col("block"), F.col("number")))
    return p.withColumn("ready", (F.col("cca") != "") & codes.is_valid(F.col("number")) & F.col("reviewed"))


PARCELS_SQL = """p0 AS (SELECT o_orderkey AS fid, n_regionkey + 1 AS dep, c_nationkey AS mun, o_custkey % 12 AS sec, '0' AS chac,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE (o_custkey % 10000)::VARCHAR END AS mz,
  CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '000A' WHEN 2 THEN (o_orderkey % 1000)::VARCHAR || 'a' WHEN 3 THEN '12345' ELSE (o_orderkey % 10000)::VARCHAR END AS raw_no,
  o_orderkey % 5 <> 0 AS reviewed, round(o_totalprice * 100)::BIGINT AS area_c
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
CODED_SQL = """p1 AS (SELECT *, CASE WHEN regexp_full_match(mz, '[0-9]{1,4}') THEN lpad(dep::VARCHAR, 2, '0') || lpad(mun::VARCHAR, 2, '0') || lpad(sec::VARCHAR, 3, '0') || '0000' || lpad(mz, 4, '0') ELSE '' END AS block,
  CASE WHEN raw_no = '' THEN '' WHEN length(raw_no) >= 4 THEN upper(raw_no) ELSE lpad(upper(raw_no), 4, '0') END AS number FROM {p0}),
p2 AS (SELECT *, CASE WHEN block <> '' AND length(number) BETWEEN 1 AND 4 THEN block || number ELSE '' END AS cca,
  regexp_full_match(number, '[0-9]{3}[0-9A-ZÑ]') AND coalesce(try_cast(regexp_extract(number, '^[0-9]+') AS INT), 0) >= 1 AS ok FROM p1)"""
BASE = f"WITH {PARCELS_SQL}, {CODED_SQL.replace('{p0}', 'p0')} "


@query(BASE + "SELECT fid, number, cca, area_c FROM p2 WHERE cca <> '' AND ok AND reviewed")
def q_publishable(spark, d):
    return coded(parcels(spark, d)).where("ready").select("fid", "number", "cca", "area_c")


@query(BASE + "SELECT block, count(*) AS n, count(*) FILTER (WHERE NOT (cca <> '' AND ok AND reviewed)) AS n_blocked, sum(area_c)::BIGINT AS area_c FROM p2 GROUP BY block")
def q_incomplete_by_block(spark, d):
    return coded(parcels(spark, d)).groupBy("block").agg(F.count("*").alias("n"), F.count_if(~F.col("ready")).alias("n_blocked"), F.sum("area_c").alias("area_c"))


@query(BASE + """SELECT fid, substr(cca, 1, 4) || '003' || substr(cca, 8, 4) || '0007' || number AS cca FROM p2 WHERE cca <> ''""")
def q_code_rebuild(spark, d):
    p = coded(parcels(spark, d)).where("cca <> ''")
    part = lambda a, n: F.substring("cca", a, n)
    block = codes.block_code({"dep": part(1, 2), "mun": part(3, 2), "sec": F.lit("3"), "chac": part(8, 4), "mz": F.lit("7")})
    return p.select("fid", codes.code_of(block, F.col("number")).alias("cca"))


@query(f"""WITH {PARCELS_SQL}, e AS (SELECT o_orderkey AS fid, (o_orderkey % 900 + 1)::VARCHAR AS e_no, o_orderkey % 33 = 0 AS deleted FROM orders WHERE o_orderkey % 11 = 0)
SELECT p0.fid, coalesce(e_no, raw_no) AS raw_no, CASE WHEN e.fid IS NULL THEN sec ELSE 3 END AS sec, CASE WHEN e.fid IS NULL THEN mz ELSE '7' END AS mz, (reviewed OR e.fid IS NOT NULL) AS reviewed
FROM p0 LEFT JOIN e ON p0.fid = e.fid WHERE NOT coalesce(deleted, false)""")
def q_review_merge(spark, d):
    k = F.col("o_orderkey")
    e = _t(spark, d, "orders").where(k % 11 == 0).select(k.alias("fid"), (k % 900 + 1).cast("string").alias("e_no"), (k % 33 == 0).alias("deleted"))
    j = parcels(spark, d).join(e, "fid", "left").where(~F.coalesce("deleted", F.lit(False)))
    new = F.col("e_no").isNotNull()
    return j.select("fid", F.coalesce("e_no", "raw_no").alias("raw_no"), F.when(new, F.lit(3).cast("long")).otherwise(F.col("sec")).alias("sec"), F.when(new, "7").otherwise(F.col("mz")).alias("mz"), (F.col("reviewed") | new).alias("reviewed"))


@query(BASE + """SELECT fid, number, array_to_string(list_transform(list_sort(list_transform(list_filter(list_distinct([number, CASE WHEN ltrim(number, '0') = '' THEN '0' ELSE ltrim(number, '0') END,
  CASE WHEN regexp_full_match(number, '[0-9]{3}[A-ZÑ]') THEN substr(number, 2) END, CASE WHEN regexp_full_match(number, '00[0-9]{2}') THEN substr(number, 3) END]), lambda x: x IS NOT NULL),
  lambda x: {'n': length(x), 'v': x})), lambda x: x.v), ',') AS variants FROM p2 WHERE number <> ''""")
def q_label_variants(spark, d):
    return coded(parcels(spark, d)).where("number <> ''").select("fid", "number", F.array_join(rules.display_forms(F.col("number")), ",").alias("variants"))


SEG_SQL = "s AS (SELECT l_orderkey, l_linenumber, min(l_partkey) % 200 AS c0, min(l_suppkey) % 100 AS r0, max(l_partkey) % 200 + min(l_quantity)::INT AS c1, max(l_suppkey) % 100 AS r1 FROM lineitem GROUP BY 1, 2)"


def segments(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 200).alias("c0"), (F.min("l_suppkey") % 100).alias("r0"), (F.max("l_partkey") % 200 + F.min("l_quantity").cast("int")).alias("c1"), (F.max("l_suppkey") % 100).alias("r1"))


@query(f"WITH {SEG_SQL} SELECT *, (1000 + 0.5 * c0)::DOUBLE AS x, (2000 - 0.5 * r0)::DOUBLE AS y, floor((1000 + 0.5 * c0 - 1000) / 0.5)::BIGINT AS c, floor((2000 - 0.5 * r0 - 2000) / -0.5)::BIGINT AS r FROM s")
def q_affine_roundtrip(spark, d):
    g = geo.geotransform(1000, 0.5, 0, 2000, 0, -0.5)
    x, y = geo.to_world(F.col("c0"), F.col("r0"), g)
    s = segments(spark, d).withColumn("x", x).withColumn("y", y)
    c, r = geo.to_cell(F.col("x"), F.col("y"), g)
    return s.withColumn("c", c).withColumn("r", r)


@query(f"""WITH {SEG_SQL}, f AS (SELECT *, CASE WHEN atan2(r1-r0, c1-c0) < 0 THEN atan2(r1-r0, c1-c0) + pi() WHEN atan2(r1-r0, c1-c0) >= pi() THEN 0 ELSE atan2(r1-r0, c1-c0) END AS a FROM s)
SELECT l_orderkey, l_linenumber, round(sqrt((c1-c0)*(c1-c0)+(r1-r0)*(r1-r0)), 4) AS length, round(a, 4) AS angle, round(r0*cos(a) - c0*sin(a), 4) + 0.0 AS "offset",
round(least(c0*cos(a) + r0*sin(a), c1*cos(a) + r1*sin(a)), 4) + 0.0 AS tmin, round(greatest(c0*cos(a) + r0*sin(a), c1*cos(a) + r1*sin(a)), 4) + 0.0 AS tmax FROM f""")
def q_segment_features(spark, d):
    f = geo.features(*(F.col(c) for c in ("c0", "r0", "c1", "r1")))
    return segments(spark, d).select("l_orderkey", "l_linenumber", *((F.round(v, 4) + 0.0).alias(k) for k, v in f.items()))


def grid(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), (F.col("l_linenumber") % 2).alias("ori"), F.col("l_quantity").cast("int").alias("pos")).distinct()


@query("""WITH g AS (SELECT DISTINCT l_orderkey, l_linenumber % 2 AS ori, l_quantity::INT AS pos FROM lineitem),
n AS (SELECT l_orderkey, count(*) FILTER (WHERE ori = 1) AS v, count(*) FILTER (WHERE ori = 0) AS h FROM g GROUP BY 1)
SELECT l_orderkey, greatest(v - 1, 0) * greatest(h - 1, 0) AS n_faces FROM n WHERE v > 1 AND h > 1""")
def q_faces(spark, d):
    return topology.cells(grid(spark, d)).groupBy(F.col("sheet").alias("l_orderkey")).agg(F.count("*").alias("n_faces"))


ATTEMPTS_SQL = """a AS (SELECT user_id AS sheet, (event_id % 2)::INT AS recover, CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 6 WHEN 'error' THEN 8 WHEN 'purchase' THEN 10 ELSE 14 END AS stroke_px,
  round(least(1, max(value) / 300), 4) AS cov, max(value) > 60 AS has_faces FROM events GROUP BY user_id, event_type, event_id % 2),
c AS (SELECT sheet, recover, count_if(has_faces) AS n, max(CASE WHEN has_faces THEN CASE WHEN cov < 0.5 THEN 0.001 ELSE cov END END) AS best FROM a GROUP BY 1, 2),
chosen AS (SELECT a.sheet, a.recover, CASE WHEN n = 0 THEN max(stroke_px)
  WHEN a.recover = 1 THEN max(stroke_px) FILTER (WHERE has_faces AND CASE WHEN cov < 0.5 THEN 0.001 ELSE cov END = best)
  ELSE max(stroke_px) FILTER (WHERE has_faces AND CASE WHEN cov < 0.5 THEN 0.001 ELSE cov END >= best - 0.3) END AS stroke_px FROM a JOIN c USING (sheet, recover) GROUP BY a.sheet, a.recover, n)"""


def attempts(spark, d):
    px = F.expr("CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 6 WHEN 'error' THEN 8 WHEN 'purchase' THEN 10 ELSE 14 END")
    e = _t(spark, d, "events").groupBy(F.col("user_id").alias("sheet"), "event_type", (F.col("event_id") % 2).cast("int").alias("recover")).agg(F.round(F.least(F.lit(1.0), F.max("value") / 300), 4).alias("cov"), (F.max("value") > 60).alias("has_faces"))
    return e.withColumn("stroke_px", px).drop("event_type")


@query(f"WITH {ATTEMPTS_SQL} SELECT sheet, recover, stroke_px, cov, has_faces FROM chosen JOIN a USING (sheet, recover, stroke_px)")
def q_width_select(spark, d):
    return select.width(attempts(spark, d))


@query(f"""WITH {ATTEMPTS_SQL}, j AS (SELECT sheet, recover, stroke_px, cov, has_faces FROM chosen JOIN a USING (sheet, recover, stroke_px))
SELECT * FROM j p WHERE (recover = 0 AND (has_faces OR NOT EXISTS (SELECT 1 FROM j q WHERE q.sheet = p.sheet AND q.recover = 1 AND q.has_faces)))
OR (recover = 1 AND NOT EXISTS (SELECT 1 FROM j q WHERE q.sheet = p.sheet AND q.recover = 0 AND (q.has_faces OR NOT p.has_faces)))""")
def q_escalated(spark, d):
    return select.escalated(select.width(attempts(spark, d)))


READS_SQL = "SELECT l_orderkey // 4 AS poly_idx, l_linenumber AS marker_id, 5 * (l_partkey % 9) AS angle, lpad((l_suppkey % 3 + 8)::VARCHAR, CASE WHEN l_suppkey % 2 = 0 THEN 2 ELSE 3 END, '0') || CASE l_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'Ñ' WHEN 2 THEN '-' ELSE '' END AS text, round(10 * l_discount, 2) AS min_conf, l_quantity::INT - 10 AS dist FROM lineitem"


def reads(spark, d):
    """Reads by marker of a polygon; some have no form of a number, some Ñ."""
    tail = F.expr("CASE l_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'Ñ' WHEN 2 THEN '-' ELSE '' END")
    body = (F.col("l_suppkey") % 3 + 8).cast("string")
    text = F.concat(F.when(F.col("l_suppkey") % 2 == 0, F.lpad(body, 2, "0")).otherwise(F.lpad(body, 3, "0")), tail)
    return _t(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("poly_idx"), F.col("l_linenumber").alias("marker_id"), (5 * (F.col("l_partkey") % 9)).alias("angle"), text.alias("text"), F.round(10 * F.col("l_discount"), 2).alias("min_conf"), (F.col("l_quantity").cast("int") - 10).alias("dist"))


@query(f"""WITH m AS (SELECT poly_idx, marker_id, max(dist) AS dist FROM ({READS_SQL}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY poly_idx ORDER BY dist DESC, marker_id) AS k FROM m WHERE dist >= 15) SELECT poly_idx, marker_id, dist FROM r WHERE k <= 4""")
def q_topk_markers(spark, d):
    m = reads(spark, d).where("dist >= 15").groupBy("poly_idx", "marker_id").agg(F.max("dist").alias("dist"))
    return select.first_of(m, ["poly_idx"], [F.desc("dist"), F.col("marker_id")], 4)


CONSENSUS_SQL = f"""t AS (SELECT poly_idx, marker_id, text, count(DISTINCT angle) AS n, max(min_conf) AS conf FROM ({READS_SQL})
WHERE regexp_full_match(text, '[0-9]{{1,4}}|[0-9]{{1,3}}[A-ZÑ]') AND length(text) >= 2 GROUP BY 1, 2, 3),
w AS (SELECT poly_idx, marker_id, max_by(text, (n, conf, length(text), text)) AS text FROM t GROUP BY 1, 2),
c AS (SELECT poly_idx, marker_id, w.text, n AS n_angles, round(CASE WHEN (SELECT max(o.conf) FROM t o WHERE o.poly_idx = t.poly_idx AND o.marker_id = t.marker_id AND o.text <> t.text) >= conf
THEN least(conf, 0.899999) ELSE conf END, 6) AS conf FROM w JOIN t USING (poly_idx, marker_id, text))"""


@query(f"WITH {CONSENSUS_SQL} SELECT poly_idx, marker_id, text, n_angles, conf FROM c")
def q_consensus(spark, d):
    return select.consensus(reads(spark, d))


@query(f"""WITH {CONSENSUS_SQL}, m AS (SELECT DISTINCT poly_idx, marker_id, max(dist) OVER (PARTITION BY poly_idx, marker_id) AS dist FROM ({READS_SQL})),
k AS (SELECT *, row_number() OVER (PARTITION BY poly_idx ORDER BY dist DESC, marker_id) AS k FROM m WHERE dist >= 15),
b AS (SELECT poly_idx, max((conf, text)) AS x FROM c JOIN k USING (poly_idx, marker_id) WHERE k <= 3 GROUP BY 1), e AS (SELECT poly_idx, x[1] AS conf, x[2] AS text FROM b)
SELECT poly_idx, CASE WHEN conf >= 0.5 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.conf >= 0.5 AND upper(o.text) = upper(e.text) AND o.poly_idx < e.poly_idx) THEN text ELSE '' END AS text,
CASE WHEN conf >= 0.9 THEN 'auto' WHEN conf >= 0.5 THEN 'suggest' ELSE 'none' END AS band FROM e""")
def q_read_polygons(spark, d):
    r = reads(spark, d)
    m = r.groupBy("poly_idx", "marker_id").agg(F.max("dist").alias("dist")).where("dist >= 15")
    near = select.first_of(m, ["poly_idx"], [F.desc("dist"), F.col("marker_id")], 3)
    best = select.consensus(r).join(near, ["poly_idx", "marker_id"]).groupBy("poly_idx").agg(F.max(F.struct("conf", "text")).alias("b")).select("poly_idx", "b.*")
    return select.first_claims(best, F.col("conf") >= rules.SUGGEST).select("poly_idx", "text", rules.band(F.col("conf")).alias("band"))


@query(f"""WITH s AS (SELECT poly_idx, text, 1000 - 900 * min_conf - 3 * (poly_idx % 7) AS score FROM ({READS_SQL}) WHERE regexp_full_match(text, '[0-9]{{1,4}}|[0-9]{{1,3}}[A-ZÑ]')),
r AS (SELECT *, row_number() OVER (PARTITION BY poly_idx ORDER BY score - 800 * length(text), text, score) AS k FROM s), b AS (SELECT * FROM r WHERE k = 1)
SELECT poly_idx, CASE WHEN length(text) >= 2 AND score <= 200 AND NOT EXISTS (SELECT 1 FROM b o WHERE length(o.text) >= 2 AND o.score <= 200 AND upper(o.text) = upper(b.text) AND o.poly_idx < b.poly_idx) THEN text ELSE '' END AS text FROM b""")
def q_first_claim(spark, d):
    return select.free_read(reads(spark, d).select("poly_idx", "text", (1000 - 900 * F.col("min_conf") - 3 * (F.col("poly_idx") % 7)).alias("score")))


@query("""SELECT user_id::VARCHAR || '_' || event_type || '.png' AS file, max(event_id) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f
WHERE f.user_id = e.user_id AND f.event_type = e.event_type AND (date_trunc('second', f.ts), f.event_id) > (date_trunc('second', e.ts), e.event_id)) GROUP BY 1""")
def q_harvest_latest(spark, d):
    e = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct(F.date_trunc("second", "ts"), "event_id")).alias("n"))
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("_"), "event_type", F.lit(".png")).alias("file"), "n")
