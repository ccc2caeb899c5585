"""Chat formatting after collapsing cumulative snapshots.

A conversation's turns, in order, give a rolling hash of each prefix. A conversation whose whole hash is a
proper prefix of another is dropped by an anti-join; of equal conversations the smallest id stays. Prefix hashes are made
distinct before the join, so an opening that a third of all conversations share is one row.

Turns that repeat (conv_id, turn) are ordered by role and text, null turns come first; null roles and texts count as empty. Turns
with a null conv_id are one conversation of that id, kept only if no other equals it. Only conv_id, turn, role and text are
read, whatever other columns are named. A conversation must fit in a task. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, table


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered: the conversations that no longer one begins with."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # The length of the role parts it from the text.
    t = t.withColumn("h", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "h"))).alias("ts"))
    chain = F.aggregate("ts", F.array().cast("array<string>"), lambda acc, x: F.concat(acc, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), x.h)))))
    c = durable(c.withColumn("prefixes", chain).withColumn("whole", F.element_at("prefixes", -1)))
    proper = c.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("whole")).distinct()
    # One row for each whole, so equal conversations aren't gathered before the joins.
    ends = c.groupBy("whole").agg(F.min("conv_id").alias("first")).join(proper, "whole", "left_anti").withColumnRenamed("whole", "of")
    kept = c.join(ends, F.col("conv_id").eqNullSafe(F.col("first")) & (F.col("whole") == F.col("of")))
    line = lambda x: F.concat(F.lit("<|"), x.role, F.lit("|>\n"), x.text, F.lit("\n<|end|>"))
    return kept.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", line), "\n").alias("rendered"))


def op5_chats(spark, sf_dir: str) -> DataFrame:
    return maximal(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns,
        string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>', chr(10) ORDER BY turn NULLS FIRST, role, text) AS rendered,
        list([role, text] ORDER BY turn NULLS FIRST, role, text) AS k FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, length(rendered)::BIGINT AS n_chars, sha256(rendered) AS rendered_sha256 FROM c
WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.k[1] = c.k[1] AND d.k[1:len(c.k)] = c.k AND (len(d.k) > len(c.k) OR (len(d.k) = len(c.k) AND d.conv_id < c.conv_id)))
"""
