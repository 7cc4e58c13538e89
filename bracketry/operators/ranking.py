"""Numbers over a whole table without one task for all rows: parts by range, then offsets from the parts' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bracketry.operators.graph import stored


def running(df: DataFrame, order: list[str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """df with the sum of value over all rows before in that order (0 for the first). Rows equal in the order are one after
    another in no fixed order, so give a full one."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.withColumn("__v", value).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part").agg(F.sum("__v").alias("__t"))  # a row for each part
    offset = totals.withColumn("__o", F.coalesce(F.sum("__t").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__s", F.coalesce(F.sum("__v").over(w), F.lit(0)))
    return own.join(F.broadcast(offset), "__part").withColumn(name, F.col("__s") + F.col("__o")).drop("__v", "__part", "__s", "__o")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with 0, 1, ... in that order."""
    return running(df, order, F.lit(1), name)
