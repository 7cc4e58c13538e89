"""The grouping pipeline: frames to groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bracketry.operators.graph import connected_components
from bracketry.operators.features import fused_vectors
from bracketry.operators.pairs import forest_levels, masked_pairs
from bracketry.operators.passes import Params, refined
from bracketry.operators.windows import plateau_threshold


def group_frames(frames: DataFrame, least: float = 0.70, overlap: int = 24) -> DataFrame:
    """filename, label: components of the frames that correlate at `least` over `overlap` pixels or more."""
    edges = masked_pairs(frames, least, overlap, forest=True).select("a", "b")
    labels = connected_components(frames.select(F.col("frame_id").alias("node")), edges)
    return frames.join(labels, frames.frame_id == labels.node).select("filename", "label")


def curve(nodes: int, edges: DataFrame) -> DataFrame:
    """t, c: the number of components at each of 70 levels, from the levels of a spanning forest."""
    per = edges.groupBy(F.col("level").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rows = edges.sparkSession.range(0, 70).join(per, F.col("k") >= F.col("id"), "left").groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("joined"))
    return rows.select(F.col("id").alias("t"), (F.lit(nodes) - F.col("joined")).cast("double").alias("c"))


def group_images(frames: DataFrame, p: Params | None = None, side: int = 64, passes: bool = True) -> DataFrame:
    """frame_id, label: frames of like edges and wavelets, at the threshold where the number of groups stops growing, then
    refined by all passes. No frames give no groups; one frame is a group."""
    from bracketry.operators.graph import stored

    vectors = stored(fused_vectors(frames, side))
    edges = stored(forest_levels(vectors, lambda sim: np.clip(np.floor((np.round(sim, 9) - 0.2) * 100), -1, 69).astype(np.int64)))
    cut = plateau_threshold(curve(vectors.count(), edges)).first()["threshold"]
    labels = connected_components(frames.select(F.col("frame_id").alias("node")), edges.where(F.col("level") >= F.lit(cut)).select("a", "b")).withColumnRenamed("node", "frame_id")
    return refined(labels, frames, p) if passes else labels
