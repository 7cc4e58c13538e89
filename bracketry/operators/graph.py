"""Graph operators on edges (a, b)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges (both ways) up to so many are finished in one task.
FEW = 1 << 17


def stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bracketry-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, a, b = np.arange(len(nodes)), place[: len(a)], place[len(a) :]
    while len(a):
        new = label.copy()
        np.minimum.at(new, label[a], label[b])
        np.minimum.at(new, label[b], label[a])
        while (new[new] != new).any():
            new = new[new]
        label, left = new, new[a] != new[b]
        a, b = a[left], b[left]
    return nodes, nodes[label]


def _finished(edges: DataFrame) -> DataFrame:
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("a", arrow), ("b", arrow)]))
        was, label = _least_reached(rows.column("a").to_numpy(), rows.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(was, arrow), pa.array(label, arrow)], names=["was", "to"])

    arrow = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    return edges.coalesce(1).mapInArrow(run, f"was {kind}, to {kind}")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least node that each reaches; nodes without edges are their own. In each round all nodes move to the
    least node next to them, and on to the least next to that one, and edges go with them; what is left of few edges is
    finished in one task. Every round is written to the shared folder."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = stored(both.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b"))
    labels = stored(nodes.select("node", F.col("node").alias("label")))
    while left := both.count():
        few = left <= FEW and both.schema["a"].dataType.simpleString() in ("bigint", "int")
        if few:
            move = stored(_finished(both))
        else:
            near = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("was"), F.least("a", "b").alias("to")))
            move = stored(near.join(near.select(F.col("was").alias("to"), F.col("to").alias("on")), "to").select("was", F.col("on").alias("to")))
        labels = stored(labels.join(move, F.col("label") == F.col("was"), "left").select("node", F.coalesce("to", "label").alias("label")))
        if few:
            break
        for end in ("a", "b"):
            both = both.join(move.select(F.col("was").alias(end), F.col("to").alias(f"to_{end}")), end)
        both = stored(both.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct())
    return labels


def complement_components(nodes: DataFrame, different: DataFrame) -> DataFrame:
    """node, label within each grp of nodes (grp, node): two are linked unless they are known to be different (a, b)."""
    x, y = nodes.select("grp", F.col("node").alias("a")), nodes.select("grp", F.col("node").alias("b"))
    pairs = x.join(y, "grp").where("a < b").join(different, ["a", "b"], "left_anti")
    return connected_components(nodes.select("node"), pairs)
