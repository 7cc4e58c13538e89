"""Rules on URLs: every URL becomes host-suffix and path-prefix expressions, which meet the rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import small, table

#: Rules that are broadcast; with more of them the expressions are joined by a shuffle.
BROADCAST_RULES = 200_000
#: Hex digits of the short prefix.
SHORT = 8
DEFAULT = "allow"

# fixed values: verdict, host and path of the rules to judge pages by
PAGE_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str = "url") -> tuple:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``urls`` with host, path, rule (null if none fits) and verdict.

    ``rules``: verdict, host, path. A rule fits its host and all subdomains where the path starts with the rule's. The
    longest rule wins; between equal rules block wins over allow. Rows of ``urls`` stay as they are, repeated ones too,
    whatever other columns there are. No rules: the default for all.
    """
    host, path = parts(url)
    rules = rules.select(
        F.col("verdict").alias("r_verdict"), F.translate("host", _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path")
    ).where("r_host is not null and r_verdict is not null")
    # at most one entry per length of a rule's path, so bounded by the longest path and not by the rules
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    rules = rules.withColumn("r_full", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_full", 1, SHORT))
    if small(rules, BROADCAST_RULES):
        rules = F.broadcast(rules)

    split = urls.withColumns({"__host": host, "__path": path})
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wanted = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("__path"))
    prefixes = F.transform(wanted, lambda n: F.substring(F.col("__path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    distinct = split.select("__host", "__path").distinct()
    asked = distinct.select("__host", "__path", F.explode(pairs).alias("e")).withColumn("e_full", _digest(F.col("e.h"), F.col("e.p")))
    asked = asked.withColumn("e_short", F.substring("e_full", 1, SHORT))
    fits = asked.join(rules, (F.col("e_short") == F.col("r_short")) & (F.col("e_full") == F.col("r_full")))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), (F.col("r_verdict") == "block").cast("int").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = fits.groupBy(F.col("__host").alias("b_host"), F.col("__path").alias("b_path")).agg(F.max(rank).alias("__best"))
    if {"host", "path", "rule", "verdict"} & {c.lower() for c in urls.columns}:
        split = split.drop(*(c for c in urls.columns if c.lower() in {"host", "path", "rule", "verdict"}))
    joined = split.join(best, (F.col("__host") == F.col("b_host")) & (F.col("__path") == F.col("b_path")), "left").drop("b_host", "b_path")
    return joined.withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__best.rule"), "verdict": F.coalesce("__best.verdict", F.lit(default))}).drop("__host", "__path", "__best")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(PAGE_RULES, "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH r(verdict, rh, rp) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host, path,
  (SELECT max_by(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT max_by(verdict, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM q
"""
