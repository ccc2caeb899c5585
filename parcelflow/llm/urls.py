"""URL filters: host and path rules, then a character language-model ratio.

Urls that a rule accepts or rejects train two smoothed variable-order Markov models over the raw characters of
host and path (orders 0 to ORDER, each backing off to the lower by Witten-Bell weights; only the host is
in lower case, as hosts have none). Other urls are judged by the difference of log-likelihood per character against
a threshold between the classes' means, in proportion to their spreads. Nothing is folded, so the tables of
grams grow with the corpus; they are grouped and joined by shuffle. A gram that makes up more than 1/HOT of all
places has its ratio broadcast instead: there are at most HOT of those, whatever the corpus. DataFrame functions only.

A null url, or one without ://, has an empty host and path and is judged by the method as the empty text.
Without training urls of a class, the verdict is allow. Repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, table

# Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER, HOT = 5, 2000
# Noncharacters of Unicode, which no text holds: before the first and after the last character.
BEFORE, AFTER = "\ufdd0", "\ufdd1"


def parts(url: str = "url"):
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = parts()
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("by_rule", verdict)


def _log_ratio(grams: DataFrame) -> DataFrame:
    """g, llr for every gram of ORDER + 1 characters (g, allow, block: training counts): log P(accepted) - log P(rejected)."""
    classes = ("allow", "block")
    sums = [F.sum(c).alias(c) for c in classes]
    tables = [grams.select("g", *classes)]
    for k in range(ORDER):
        tables.append(durable(tables[-1].groupBy(F.expr("substring(g, 2)").alias("g")).agg(*sums)))
    tables.reverse()
    # Characters of the corpus and one for all others.
    symbols, *total = tables[0].agg(F.count("*"), *(F.sum(c) for c in classes)).first()
    p = tables[0].select("g", *((F.col(c) + 1) / F.lit(float((n or 0) + symbols + 1)) for c, n in zip(classes, total, strict=True))).toDF("g", *classes)
    for k in range(1, ORDER + 1):
        now = tables[k].withColumn("context", F.substring("g", 1, k)).withColumn("lower", F.expr("substring(g, 2)"))
        seen = now.groupBy("context").agg(*(F.sum(c).alias(f"k_{c}") for c in classes), *(F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in classes))
        now = now.join(seen, "context").join(p.toDF("lower", *(f"p_{c}" for c in classes)), "lower")
        smooth = [F.when(F.col(f"k_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"k_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"p_{c}")).alias(c) for c in classes]
        p = durable(now.select("g", *smooth))
    return p.select("g", (F.log("allow") - F.log("block")).alias("llr"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log-likelihood difference per character)."""
    rows = ruled(pages, rules)
    rows = rows.groupBy("page_id", "host", "path", "rule", "by_rule").agg(F.count("*").alias("times"))
    # The key of a row names it in the shuffles below; it is fixed by the checkpoint.
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    known = [F.when(F.col("by_rule") == c, F.col("times")).otherwise(0).alias(c) for c in ("allow", "block")]
    chars = rows.select("row", *known, F.split(F.concat("host", "path"), "").alias("chars"))
    # Splitting the empty text gives one empty character.
    chars = chars.withColumn("chars", F.concat(F.array_repeat(F.lit(BEFORE), ORDER), F.filter("chars", lambda c: c != ""), F.array(F.lit(AFTER))))
    places = F.sequence(F.lit(0), F.size("chars") - ORDER - 1)
    grams = chars.select("row", "allow", "block", F.explode(F.transform(places, lambda i: F.concat(*(F.col("chars")[i + j] for j in range(ORDER + 1))))).alias("g"))
    counts = durable(grams.groupBy("g").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count("*").alias("places")))
    ratio = _log_ratio(counts).join(counts.select("g", "places"), "g")
    total = counts.agg(F.sum("places")).first()[0] or 0
    hot = F.col("places") * HOT > total
    ratio = durable(ratio.select("g", "llr", hot.alias("hot")))
    often, seldom = (ratio.where(x).select("g", "llr") for x in (F.col("hot"), ~F.col("hot")))
    marked = grams.select("row", "g").join(F.broadcast(often), "g", "left")
    met = marked.where("llr is not null").groupBy("row").agg(F.sum("llr").alias("llr"), F.count("*").alias("n"))
    rest = marked.where("llr is null").select("row", "g").join(seldom.hint("merge"), "g").groupBy("row").agg(F.sum("llr").alias("llr"), F.count("*").alias("n"))
    score = met.unionByName(rest).groupBy("row").agg((F.sum("llr") / F.sum("n")).alias("score"))
    scored = durable(rows.join(score, "row"))
    of = lambda c, f: f(F.when(F.col("by_rule") == c, F.col("score")))
    ma, mr, sa, sr = scored.agg(*(of(c, f) for f in (F.avg, F.stddev_pop) for c in ("allow", "block"))).first()
    if ma is None or mr is None:
        cut = None
    else:
        cut = (ma * sr + mr * sa) / (sa + sr) if sa + sr > 0 else (ma + mr) / 2
    by_model = F.lit("allow") if cut is None else F.when(F.col("score") >= cut, "allow").otherwise("block")
    out = scored.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")


def op9_urls(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
