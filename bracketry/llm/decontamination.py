"""Benchmark decontamination with DataFrame functions only: a broadcast hash set of benchmark n-grams against every window of every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import salt, saved, small, spread_over, table

N = 10
#: Windows of the benchmark that are broadcast; a larger benchmark is joined by a shuffle on the windows' hashes.
BROADCAST_WINDOWS = 1_000_000
#: Tasks that the rows of one text are spread over where they meet its hits.
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str):
    """Words of a text with A-Z lower-cased; none for null."""
    found = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _BREAKS)
    return F.filter(found, lambda w: w != "")


def _windows(of, k):
    """Place, length and 64-bit hash of each window of k words of the array ``of``."""
    n = F.size(of) - k
    each = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("i"), F.lit(k).alias("k"), F.xxhash64(F.slice(of, i + 1, k)).alias("h")))
    return F.when(n >= 0, each).otherwise(F.array().cast("array<struct<i:int,k:int,h:bigint>>"))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """item_id, k, h, gram: the distinct windows of n words; an item of fewer words, but not none, is one window."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(n)))
    at = w.select("item_id", "k", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    return at.select("item_id", "k", F.slice("w", F.col("i"), F.col("k")).alias("gram")).distinct().withColumn("h", F.xxhash64("gram"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Of each distinct text with any: __key (of the text), n_hit, positions (of the hit words, from 0), items (their ids, sorted)."""
    grams = saved(benchmark_windows(benchmark, n), "benchmark-windows")
    lengths = sorted(r[0] for r in grams.select("k").distinct().collect())  # n values at most
    if not lengths:
        return docs.select(_key("text").alias("__key"), F.array().cast("array<int>").alias("positions"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_hit")).limit(0)
    near = small(grams, BROADCAST_WINDOWS)
    if near:
        grams = F.broadcast(grams)
    # explode_outer: for explode, Spark would infer a filter on the windows and compute them twice. The windows are a
    # column of their own, so that explode and join compile into one loop which
    # copies neither a text's words nor its windows unless a hash is met
    split = docs.select(_key("text").alias("__key"), words("text").alias("w"))
    split = split.select("__key", "w", F.concat(*(_windows(F.col("w"), k) for k in lengths)).alias("at"))
    met = (F.col("x.h") == F.col("h")) & (F.col("x.k") == F.col("k"))
    if near:
        at = split.select("__key", "w", F.explode_outer("at").alias("x"))
        rows = at.join(grams, met & (F.slice("w", F.col("x.i") + 1, F.col("k")) == F.col("gram"))).select("__key", F.col("x.i").alias("i"), "k", "item_id")
    else:
        # windows go to the grams without their texts; a text's words are joined back, for texts that met a hash only
        at = split.select("__key", F.explode_outer("at").alias("x")).join(grams, met).select(F.col("__key").alias("hit_key"), F.col("x.i").alias("i"), "k", "item_id", "gram").distinct()
        rows = at.join(split.select("__key", "w").dropDuplicates(["__key"]), F.col("hit_key") == F.col("__key"))
        rows = rows.where(F.slice("w", F.col("i") + 1, F.col("k")) == F.col("gram")).select("__key", "i", "k", "item_id")
    spots = rows.groupBy("__key").agg(F.collect_set(F.struct("i", "k")).alias("s"), F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["i"], x["i"] + x["k"] - 1))))
    return spots.select("__key", covered.alias("positions"), "items").withColumn("n_hit", F.size("positions").cast("long"))


def _key(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def _salt(docs: DataFrame):
    """By the other columns, so that copies of a text are told apart."""
    plain = [c for c, kind in docs.dtypes if c.lower() != "text" and not kind.startswith("map")]
    return salt(SALTS, *plain)


def mark(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with n_words, n_hit, positions, items, n_items, items_sha256, contaminated. Rows stay, repeated ones too; a null text has no words."""
    new = ["n_words", "n_hit", "positions", "items", "n_items", "items_sha256", "contaminated"]
    kept = docs.drop(*(c for c in docs.columns if c.lower() in new))
    found = spread_over(hits(docs, benchmark, n), SALTS).withColumnsRenamed({"__key": "__hit_key", "__salt": "__hit_salt"})
    keyed = kept.withColumns({"__key": _key("text"), "__salt": _salt(kept), "n_words": F.size(words("text")).cast("long")})
    joined = keyed.join(found, (F.col("__key") == F.col("__hit_key")) & (F.col("__salt") == F.col("__hit_salt")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.drop("__key", "__hit_key", "__salt", "__hit_salt").withColumns(
        {
            "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
            "positions": F.coalesce("positions", F.array().cast("array<int>")),
            "items": items,
            "n_items": F.size(items).cast("long"),
            "items_sha256": F.sha2(F.array_join(items, ",").cast("binary"), 256),
            "contaminated": F.coalesce("n_hit", F.lit(0)) > 0,
        }
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of ``docs`` without any hit, in their own columns."""
    found = spread_over(hits(docs, benchmark, n).select("__key"), SALTS)
    return docs.withColumns({"__key": _key("text"), "__salt": _salt(docs)}).join(found, ["__key", "__salt"], "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with the hit words cut out; the text of a document with hits becomes its other words, lower-cased, a blank between."""
    marked = mark(docs, benchmark, n)
    left = F.transform(F.filter(F.transform(words("text"), lambda w, i: F.struct(w.alias("w"), F.array_contains("positions", i).alias("hit"))), lambda x: ~x["hit"]), lambda x: x["w"])
    return marked.withColumn("text", F.when(F.col("contaminated"), F.array_join(left, " ")).otherwise(F.col("text"))).select(*docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM g),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT r, i, dw.k AS k, item_id FROM dw JOIN g ON dw.k = g.k AND dw.gram = g.gram),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM h) GROUP BY r),
s AS (SELECT r, list_sort(list(DISTINCT item_id)) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN s USING (r)
"""
