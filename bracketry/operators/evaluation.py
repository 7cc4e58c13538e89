"""Partitions against an answer key: both are (filename, group)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bracketry.operators.ranking import running


def group_keys(rows: DataFrame, group: str) -> DataFrame:
    """group, members: the sorted filenames of each group."""
    return rows.groupBy(group).agg(F.sort_array(F.collect_set("filename")).alias("members"))


def matched(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """group_id of groups that are a predicted group exactly."""
    return group_keys(truth, "group_id").join(group_keys(predicted, "label").select("members").distinct(), "members", "left_semi").select("group_id")


def missed(truth: DataFrame, predicted: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    groups = truth.select("group_id").distinct()
    if left_out is not None:
        groups = groups.join(left_out, "group_id", "left_anti")
    return groups.join(matched(truth, predicted), "group_id", "left_anti")


def exact_set_score(truth: DataFrame, predicted: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    """total, matched, score."""
    groups = truth.select("group_id").distinct()
    if left_out is not None:
        groups = groups.join(left_out, "group_id", "left_anti")
    hit = matched(truth, predicted).withColumn("hit", F.lit(1))
    out = groups.join(hit, "group_id", "left").agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("hit"), F.lit(0)).alias("matched"))
    return out.withColumn("score", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0))


def composition(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, group_id, n: how many files of a group a predicted group holds."""
    return truth.join(predicted, "filename").groupBy("label", "group_id").agg(F.count(F.lit(1)).alias("n"))


def owners(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, owner, n: the group with most files in it; ties go to the smaller id."""
    w = Window.partitionBy("label").orderBy(F.desc("n"), "group_id")
    return composition(truth, predicted).withColumn("k", F.row_number().over(w)).where("k = 1").select("label", F.col("group_id").alias("owner"), "n")


def disagreements(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """group_id, kind of groups that aren't matched: over-split (more labels than one, all its own), leak (none but one
    label, which another group owns or shares), frame-mismatch (both)."""
    c = composition(truth, predicted)
    foreign = c.join(c.groupBy("label").agg(F.count(F.lit(1)).alias("groups")), "label").groupBy("group_id").agg(F.count(F.lit(1)).alias("labels"), F.max("groups").alias("most"))
    kind = F.when((F.col("labels") > 1) & (F.col("most") == 1), "over-split").when(F.col("labels") == 1, "leak").otherwise("frame-mismatch")
    return foreign.join(missed(truth, predicted), "group_id", "left_semi").select("group_id", kind.alias("kind"))


def partners(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """group_id, partner: groups that share a predicted group."""
    c = composition(truth, predicted).select("label", "group_id")
    return c.join(c.withColumnRenamed("group_id", "partner"), "label").where("group_id <> partner").select("group_id", "partner").distinct()


def rank_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc by the rank sum with mean ranks of ties: counts by distinct score, so rows never meet in one task."""
    t = df.groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    t = running(t, [score], F.col("q"), "below")
    return t.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))), F.sum("p") * F.sum("q")).alias("auc"))


def audit(truth: DataFrame, predicted: DataFrame, left_out: DataFrame) -> DataFrame:
    """total, matched, excluded, failures (missed, not excluded) and the shares of matched and of failures, in percent."""
    groups = truth.select("group_id").distinct()
    hit = matched(truth, predicted).withColumn("hit", F.lit(1))
    out = groups.join(hit, "group_id", "left").join(left_out.select("group_id").distinct().withColumn("out", F.lit(1)), "group_id", "left")
    n = out.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("matched"), F.count("out").alias("excluded"), F.count(F.when(F.col("hit").isNull() & F.col("out").isNull(), 1)).alias("failures"))
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), F.col("total")), F.lit(0.0))
    return n.withColumns({"matched_percent": share("matched"), "failed_percent": share("failures")})


def best_cut(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, accuracy: the score from which on rows count as positive that gives the best balanced accuracy; the least of equals."""
    t = df.groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    t = running(running(t, [score], F.col("p"), "p_below"), [score], F.col("q"), "q_below")
    n = df.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("ps"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("qs")).first()
    ps, qs = F.lit(n["ps"]), F.lit(n["qs"])
    a = t.withColumn("accuracy", (F.try_divide(ps - F.col("p_below"), ps) + F.try_divide(F.col("q_below"), qs)) / 2)
    best = a.agg(F.max(F.struct(F.round("accuracy", 12).alias("accuracy"), (-F.col(score)).alias("t"))).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), F.col("b.accuracy").alias("accuracy"))


def outliers(df: DataFrame, by: str, value: str) -> DataFrame:
    """df with z: how far value is from the median of its ``by``, in medians of that distance."""
    mid = df.groupBy(by).agg(F.median(value).alias("__m"))
    far = df.join(mid, by).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    return far.join(far.groupBy(by).agg(F.median("__d").alias("__s")), by).withColumn("z", F.col("__d") / (1.4826 * F.col("__s") + 1e-9)).drop("__m", "__d", "__s")
