"""Sheet metadata from file names and sidecars, and publishing of reviewed parcels and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import codes
from parcelflow.functions.rules import META, crop_name, file_parts, harvestable, sidecar_path


def from_names(sheets: DataFrame, path: str = "path") -> DataFrame:
    """path and the parts (META) that its last segment gives; null where it has another form."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    parts = file_parts(name)
    return sheets.select(F.col(path).alias("path"), *(parts.get(k, F.lit(None).cast("string")).alias(k) for k in META))


def read_sidecars(spark: SparkSession, where: str) -> DataFrame:
    """path (of the sheet) and META from sidecar files under a folder; blanks are null, and so is what isn't JSON."""
    raw = spark.read.text(where, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    kept = F.from_json("value", ", ".join(f"{k} string" for k in META))
    blank = lambda c: F.when(codes.trimmed(c) != "", codes.trimmed(c))
    rows = raw.where(F.col("file").endswith(".meta.json")).select(F.regexp_replace("file", r"\.meta\.json$", "").alias("path"), kept.alias("m"))
    return rows.select("path", *(blank(F.col("m")[k]).alias(k) for k in META))


def save_sidecars(meta: DataFrame, where: str) -> int:
    """Write one JSON line a sheet that has anything known, with the path of its sidecar; the number of them."""
    known = [F.when(codes.trimmed(F.col(k)) != "", codes.trimmed(F.col(k))).alias(k) for k in META]
    rows = meta.select(sidecar_path(F.col("path")).alias("sidecar"), *known).where(F.coalesce(*META).isNotNull())
    rows.write.mode("overwrite").json(where)
    return meta.sparkSession.read.schema(rows.schema).json(where).count()


def preferred(names: DataFrame, sidecars: DataFrame) -> DataFrame:
    """A sheet's sidecar as a whole if it has anything, or else what its name gives."""
    side = sidecars.select("path", F.struct(*META).alias("side")).where(F.coalesce(*(F.col("side")[k] for k in META)).isNotNull())
    j = names.join(side, "path", "left")
    return j.select("path", *(F.when(F.col("side").isNotNull(), F.col("side")[k]).otherwise(F.col(k)).alias(k) for k in META))


def parcel_records(rows: DataFrame) -> DataFrame:
    """Rows with geometry, with their code rebuilt from its own prefix and the current section and block, and whether they are ready.

    rows: cca, number, sec, mz, reviewed, has_geometry; other columns stay."""
    raw = codes.trimmed(F.col("cca"))
    part = lambda a, n: F.when(raw.rlike("^[0-9]{15}"), F.substring(raw, a, n)).otherwise("")
    block = codes.block_code({"dep": part(1, 2), "mun": part(3, 2), "sec": F.col("sec"), "chac": part(8, 4), "mz": F.col("mz")})
    number = codes.normalized(F.col("number"))
    out = rows.where("has_geometry").withColumn("cca", codes.parcel_code(block, number)).withColumn("number", number)
    return out.withColumn("ready", (F.col("cca") != "") & codes.valid(F.col("number")) & F.coalesce(F.col("reviewed"), F.lit(False)))


def block_records(rows: DataFrame) -> DataFrame:
    """Blocks with geometry: cca is the code of their parts, number its last four digits; ready if the code is whole."""
    code = codes.block_code({k: F.col(k) for k, _ in codes.PARTS})
    out = rows.where("has_geometry").withColumn("cca", code).withColumn("number", F.substring("cca", 12, 4))
    return out.withColumn("ready", F.col("cca") != "")


def publishable(*layers: DataFrame) -> DataFrame:
    """Records of the chosen layers, one after another and none left out: no row at all where any of them is incomplete."""
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer, allowMissingColumns=True)
    blocked = every.agg(F.coalesce(F.bool_or(~F.col("ready")), F.lit(False)).alias("blocked"))
    return every.crossJoin(F.broadcast(blocked)).where("not blocked").drop("blocked")


def append(records: DataFrame, where: str, now: str, columns: list[str]) -> int:
    """Append ready records to the destination's columns, with rounded measures and the given clock; returns how many. Blanks are left null."""
    ready = records.where("ready")
    made = {"ara": "area", "st_length_": "perimeter"}
    for to, of in made.items():
        if of in ready.columns:
            ready = ready.withColumn(to, F.bround(F.col(of), 2))
    ready = ready.withColumn("created_at", F.lit(now)).withColumn("fecha", F.lit(now[:10])).withColumnRenamed("number", "etiqueta")
    out = [F.when(F.trim(F.col(c)) != "", F.col(c)).alias(c) if dict(ready.dtypes)[c] == "string" else F.col(c) for c in columns if c in ready.columns]
    rows = ready.select(*out)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(where)
    return n


def harvest_events(confirmed: DataFrame, markers: DataFrame) -> DataFrame:
    """file, label, nmp, source, ts for confirmed labels whose marker verifies (markers: poly_idx, label, fit at most 8000)."""
    good = markers.where("fit <= 8000").groupBy("poly_idx", "label").agg(F.min_by("marker_id", "fit").alias("marker_id"))
    rows = confirmed.where(harvestable(F.col("label"), F.col("source"))).join(good, ["poly_idx", "label"])
    return rows.select(crop_name(F.col("nmp"), F.col("label")).alias("file"), "label", "nmp", "source", "ts", "marker_id")
