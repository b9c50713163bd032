"""Judges URLs by rules on hosts and paths. DataFrame functions only.

Each distinct host and path is expanded into expressions: the host and every parent domain of it, each with every
beginning of the path that is as long as the path of some rule. An expression is looked up by the first 32 bits of its
SHA-256, as rules are; the full digests then confirm. Of the rules that fit, the one with the longest ``host + path``
wins, of equally long ones the smaller text, and of one text the block. Where no rule fits, the verdict is ``allow``.

URLs are judged once per distinct host and path, so a host with a third of all pages is expanded once per path. How
rules are joined, broadcast or shuffled, is left to Spark, which knows the size of the rule table.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path what
follows it up to ``?``, ``#`` or the end. A null URL or one without ``://`` has an empty host and path and fits no rule.
Repeated rows each get a verdict. Rules with a null host, path or verdict are left out. An empty table of pages gives an
empty result; without rules all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 8
RULES = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # A host holds no slash and a path starts with one, so the text tells where the path begins.
    return F.sha2(F.concat(host, path), 256)


def expressions(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """``host``, ``path`` and the ``digest`` of each expression. ``lengths``: those of the rules' paths."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    wanted = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("path"))
    listed = urls.where("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix"), wanted.alias("wanted"))
    listed = listed.select("host", "path", "suffix", F.explode("wanted").alias("n"))
    return listed.select("host", "path", _digest(F.col("suffix"), F.expr("substring(path, 1, n)")).alias("digest"))


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path``, ``rule`` and ``verdict`` of the distinct hosts and paths that a rule fits."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        _digest(F.translate("host", UPPER, LOWER), F.col("path")).alias("digest"),
        F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"),
        F.char_length("path").alias("n"),
        "verdict",
    )
    lengths = sorted(row.n for row in rules.select("n").distinct().collect())  # at most one per possible length
    if not lengths:
        return urls.select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict")).where(F.lit(False))
    # Of equal rules the block is kept.
    known = rules.groupBy("digest", "rule").agg(F.max("verdict").alias("verdict"))
    known = known.withColumn("short", F.substring("digest", 1, PREFIX_CHARS))
    asked = expressions(urls, lengths).withColumn("short", F.substring("digest", 1, PREFIX_CHARS))
    fitting = asked.join(known.withColumnRenamed("digest", "full"), "short").where("digest = full")
    # The smallest of these is the longest rule, then the smaller text.
    rank = F.struct((-F.char_length("rule")).alias("length"), "rule", "verdict")
    best = fitting.groupBy("host", "path").agg(F.min(rank).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    best = best_rules(parsed.select("host", "path").distinct(), rules)
    # URLs without a host fit no rule, and may be many: they are dealt out by their page instead of their one key.
    parsed = parsed.withColumn("dealt", F.when(F.col("host") == "", F.xxhash64("page_id")).otherwise(0))
    return parsed.join(best.withColumn("dealt", F.lit(0).cast("long")), ["host", "path", "dealt"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )
