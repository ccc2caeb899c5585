"""Corpus pipeline: each stage works on the documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import bpe, decontaminate, near, quality, secrets
from parcelflow.llm.common import durable, sieve, table

ROW, SCORE = "_row", "_quality_score"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model accepts, null and empty texts judged like others; all of them where labels of both kinds
    are lacking and none could be fitted. Each row is judged by its own text, so repeated rows stay or go together."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if model[1].constant:
        return docs
    return quality.score(docs, model, SCORE).where(F.col(SCORE) >= quality.ACCEPT).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of each row, fixed by a checkpoint; doc_id may be null or repeat."""
    return durable(docs.withColumn(ROW, F.monotonically_increasing_id()))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (similarity of 0.8 over five-word shingles): that of the smallest doc_id,
    null last. Of blank texts, which link with nothing, one row of each doc_id and text."""
    rows = _keyed(docs)
    found = near.link(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    ids = rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), blank.alias("blank"), F.when(blank, F.sha2("text", 256)).alias("same"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first")
    by = [F.when(~F.col("blank"), F.col("component_id")), "blank", "same", F.when(F.col("blank"), F.col("doc_id"))]
    kept = found.join(ids, ROW).groupBy(*by).agg(first).select(f"first.{ROW}")
    gone = durable(rows.select(ROW).join(kept, ROW, "left_anti"))
    # Rows that surely stay aren't moved.
    maybe, stay = sieve(rows, gone, [ROW])
    return maybe.join(gone, ROW, "left_anti").unionByName(stay).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose own text is contaminated; null and empty texts stay, as do all where the benchmark is empty."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark; null and empty texts stay as they are."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the decoded text, a row for each row; null and empty texts have no tokens."""
    return bpe.digest(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near),
    ("decontaminate", drop_contaminated),
    ("secrets", hide_secrets),
    ("bpe", tokenize),
]
# SQL expresses none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written (checkpointed) before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
