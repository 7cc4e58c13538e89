"""Window operators: capture runs, ladder steps, best and runner-up, plateau threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_runs(df: DataFrame, by: str, at: Column, gap: float, order: list[str]) -> DataFrame:
    """df with run (from 0): a new one begins where ``at`` is more than ``gap`` after the row before within ``by``."""
    w = Window.partitionBy(by).orderBy(*order)
    new = F.coalesce((at - F.lag(at).over(w) > gap).cast("long"), F.lit(0))
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def ladder_step(df: DataFrame, by: str, value: str, default: float = 80.0) -> DataFrame:
    """by, step: the median difference of neighbours in order of value; the default for single rows."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(value))
    return df.select(by, step.alias("d")).groupBy(by).agg(F.coalesce(F.median("d"), F.lit(default)).alias("step"))


def best_and_margin(df: DataFrame, by: str, candidate: str, score: str) -> DataFrame:
    """by, candidate, score, margin of the best candidate over the next (null if alone); ties go to the larger candidate."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.desc(candidate))
    ranked = df.withColumns({"__k": F.row_number().over(w), "margin": F.col(score) - F.lead(score).over(w)})
    return ranked.where("__k = 1").select(by, candidate, score, "margin")


def plateau_threshold(curve: DataFrame, span: int = 3) -> DataFrame:
    """threshold of a group-count curve (t, c): the first t whose slope is at most 1.3 times the least one plus 0.5, among
    those with a count of at most half of the largest; without a slope, the last t. The curve has a fixed number of points."""
    w = Window.orderBy("t")
    slope = (F.lead("c", span).over(w) - F.lag("c", span).over(w)) / (2.0 * span)
    s = curve.withColumns({"slope": slope, "top": F.max("c").over(Window.partitionBy())})
    s = s.withColumn("slope", F.when(F.col("c") * 2 <= F.col("top"), F.col("slope"))).withColumn("least", F.min("slope").over(Window.partitionBy()))
    return s.agg(F.coalesce(F.min(F.when(F.col("slope") <= 1.3 * F.col("least") + 0.5, F.col("t"))), F.max("t")).alias("threshold"))
