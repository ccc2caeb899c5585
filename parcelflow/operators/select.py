"""Ranking and consensus operators over relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions.rules import AUTO, FREE_COST, MATCH_COST, MATCH_MARGIN, SELECT, shown

# Coverage below which an attempt scores next to nothing, and what a wider stroke may lose.
FLOOR, MARGIN = 0.50, 0.30


def first_of(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank_") <= n).drop("rank_")


def width(attempts: DataFrame) -> DataFrame:
    """The chosen attempt per sheet and mode, of those with faces: the widest near the best coverage, or in recovery
    the best. Where none has faces, the first one tried, which is the widest. attempts: sheet, recover, stroke_px, cov, has_faces."""
    a = attempts.withColumn("score", F.when(F.col("cov") >= FLOOR, F.col("cov")).when(F.col("has_faces"), 0.001).otherwise(0.0))
    best = F.max(F.when(F.col("has_faces"), F.col("score"))).over(Window.partitionBy("sheet", "recover"))
    near = F.col("has_faces") & ((F.col("recover") == 1) | (F.col("score") >= best - MARGIN))
    lead = F.when((F.col("recover") == 1) & F.col("has_faces"), -F.col("score")).otherwise(0.0)
    return first_of(a.withColumn("near", near), ["sheet", "recover"], [F.col("near").desc_nulls_last(), lead, F.col("stroke_px").desc()]).select("sheet", "recover", "stroke_px", "cov", "has_faces")


def escalated(chosen: DataFrame) -> DataFrame:
    """Per sheet the plain attempt, unless only recovery finds faces."""
    return first_of(chosen, ["sheet"], [F.col("has_faces").desc(), F.col("recover")])


def rescued(current: DataFrame, others: DataFrame, gain: float = 0.03) -> DataFrame:
    """sheet, stroke_px, cov, switched: another detector's best attempt where it covers enough more."""
    best = others.groupBy("sheet").agg(F.max_by(F.struct("stroke_px", "cov"), F.struct("cov", -F.col("stroke_px"))).alias("other"))
    j = current.join(best, "sheet", "left")
    better = F.coalesce(F.col("other.cov") >= F.col("cov") + gain, F.lit(False))
    return j.select("sheet", F.when(better, F.col("other.stroke_px")).otherwise(F.col("stroke_px")).alias("stroke_px"), F.when(better, F.col("other.cov")).otherwise(F.col("cov")).alias("cov"), better.alias("switched"))


def largest(faces: DataFrame, by: str, n: Column, area: str = "area", tie: str = "fid") -> DataFrame:
    """The n largest faces of each group; all of them if n is not positive."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(area), tie))
    return faces.withColumn("rank_", k).where((n <= 0) | (F.col("rank_") <= n)).drop("rank_")


def expected_count(faces: DataFrame, by: str, n: int, area: str = "area", tie: str = "fid") -> DataFrame:
    """by, reached (1 if a group has n faces), area of its n largest; both 0 if n is not positive."""
    if n <= 0:
        return faces.groupBy(by).agg(F.lit(0).alias("reached"), F.lit(0).cast("long").alias("area"))
    return largest(faces, by, F.lit(n), area, tie).groupBy(by).agg((F.count("*") >= n).cast("int").alias("reached"), F.sum(area).alias("area"))


def consensus(reads: DataFrame, by: tuple[str, ...] = ("poly_idx", "marker_id"), gate: float = 0.0) -> DataFrame:
    """The text most angles agree on, of each marker; its confidence is held below AUTO where a rival's is as high. One shuffle by the marker's polygon."""
    reads = reads.where(shown(F.col("text")) & (F.length("text") >= 2)).repartition(by[0])
    t = reads.groupBy(*by, "text").agg(F.countDistinct("angle").alias("n"), F.max("min_conf").alias("conf"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.desc("conf"), F.length("text").desc(), F.desc("text"))
    t = t.withColumn("r", F.row_number().over(w))
    rival = F.max(F.when(F.col("r") > 1, F.col("conf")))
    one = t.groupBy(*by).agg(F.max(F.when(F.col("r") == 1, F.struct("text", "n", "conf"))).alias("b"), rival.alias("rival"))
    conf = F.when(F.col("rival") >= F.col("b.conf"), F.least(F.col("b.conf"), F.lit(AUTO - 1e-6))).otherwise(F.col("b.conf"))
    return one.select(*by, F.col("b.text").alias("text"), F.col("b.n").alias("n_angles"), F.round(conf, 6).alias("conf")).where(F.col("conf") >= gate)


def first_claims(best: DataFrame, ok: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """All polygons; the text stays with the first one that claims it among the rows that are ok, in any case of letters, and is blank elsewhere."""
    k = F.row_number().over(Window.partitionBy(*by, ok, F.upper("text")).orderBy("poly_idx"))
    first = k == 1
    return best.withColumn("text", F.when(ok & first, F.col("text")).otherwise(""))


def free_read(reads: DataFrame) -> DataFrame:
    """poly_idx, text: the read of least score, longer ones preferred, if it is good enough; reads: poly_idx, text, score."""
    rank = F.col("score") - 800.0 * F.length("text")
    best = reads.where(shown(F.col("text"))).groupBy("poly_idx").agg(F.min(F.struct(rank.alias("rank"), "text", "score")).alias("b")).select("poly_idx", "b.text", "b.score")
    return first_claims(best, (F.length("text") >= 2) & (F.col("score") <= FREE_COST)).select("poly_idx", "text")


def marker_of(markers: DataFrame, gate: float = SELECT) -> DataFrame:
    """poly_idx, marker_id, score: of markers that read well the one farthest inside; without any, the farthest inside at score 0."""
    good = F.col("score") >= gate
    m = markers.withColumn("good", good)
    one = first_of(m, ["poly_idx"], [F.desc("good"), F.desc("dist"), F.col("marker_id")])
    return one.select("poly_idx", "marker_id", F.when(F.col("good"), F.col("score")).otherwise(0.0).alias("score"))


def decisive(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """Assigned (sheet, poly_idx, label) whose cost is low and far from the polygon's next best label."""
    key = ["sheet", "poly_idx"]
    other = costs.join(pairs.select(*key, F.col("label").alias("own")), key).where("label <> own").groupBy(*key).agg(F.min("cost").alias("next"))
    j = pairs.join(other, key, "left")
    return j.where((F.col("cost") < MATCH_COST) & (F.coalesce(F.col("next") / F.greatest("cost", F.lit(1e-9)), F.lit(float("inf"))) >= MATCH_MARGIN)).drop("next")
