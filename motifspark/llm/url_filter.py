"""URL filters: every URL is expanded into host-suffix and path-prefix expressions, which meet the rules in an equi-join on
short hash prefixes; full digests then confirm, and the longest rule wins. DataFrame functions only.

Null URLs and URLs without "://" have an empty host and path, fit no rule and get the default verdict; so do hosts without a
rule. Repeated pages and page ids keep their rows. Columns of `pages` other than the two named are ignored. An empty table of
pages gives an empty result, an empty table of rules the default verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "host string, path string, verdict string"
#: The rules of the registered query: (host, path, verdict).
BASE_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def host_and_path(url: str) -> tuple:
    """Columns: the host (after the first "://" up to / ? # or the end, A-Z lower-cased) and the path (then up to ? # or the end)."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_digits: int = 8, broadcast_rules: int = 500_000) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the rule that decided, or null), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule (host and path together)
    wins, then the one with the longer host, then block over allow. Only expressions of a shape that some rule has (number of
    host labels, length of path) are made, so a URL expands to no more rows than there are such shapes that it is long enough
    for. Distinct (host, path) pairs are judged once, so a very common URL costs one row.
    """
    ruled = rules.select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("prefix"),
    )
    digest = F.sha2("rule", 256)
    shapes = sorted((r.labels, r.prefix) for r in ruled.select("labels", "prefix").distinct().collect())  # bounded by the lengths of hosts and paths
    host, path = host_and_path(url_col)
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not shapes:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    parts = judged.select("host", "path").where("host <> ''").distinct().withColumn("labels", F.split("host", r"\."))
    known = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in shapes))
    fitting = F.filter(known, lambda s: (s["n"] <= F.size("labels")) & (s["p"] <= F.length("path")))
    expanded = (
        parts.select("host", "path", "labels", F.explode(fitting).alias("s"))
        .select("host", "path", F.concat(F.array_join(F.slice("labels", F.size("labels") - F.col("s.n") + 1, F.col("s.n")), "."), F.substring(F.col("path"), F.lit(1), F.col("s.p"))).alias("rule"))
        .select("host", "path", digest.alias("digest"))
        .withColumn("short", F.substring("digest", 1, prefix_digits))
    )
    ruled = ruled.select("rule", "verdict", "host_length", digest.alias("rule_digest"), F.substring(digest, 1, prefix_digits).alias("short"))
    rank = F.struct(F.length("rule").alias("a"), F.col("host_length").alias("b"), (F.col("verdict") == "block").alias("c"), F.col("rule"), F.col("verdict"))
    best = (
        expanded.join(broadcast_if_small(ruled, broadcast_rules), "short").where("digest = rule_digest")
        .groupBy("host", "path").agg(F.max(rank).alias("best"))
    )
    return judged.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
