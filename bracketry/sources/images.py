"""Folders of images as frames, and the files that go with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.functions.images import area_resize
from bracketry.operators.ranking import numbered
from bracketry.sources.frames import SUFFIXES

#: Sides of the grey and the colour tile.
GREY, COLOUR = 256, 128


def image_frames(spark: SparkSession, folder: str, side: int = GREY, colour: int = COLOUR) -> DataFrame:
    """frame_id (by filename), filename, tile (grey), colour (blue, green, red by pixel), decoded, brightness of each image of a flat
    folder. A file that can't be decoded stays, as zeros. One scan decodes both tiles; frames are numbered by range."""
    files = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*").where(F.col("origin").rlike(SUFFIXES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                origin, h, w, n, data = (batch.column(c)[k].as_py() for c in ("origin", "height", "width", "nChannels", "data"))
                grey, bgr, good = decoded(h, w, n, data, side, colour)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([origin]), pa.array([grey.ravel()], pa.list_(pa.float64())), pa.array([bgr.ravel()], pa.list_(pa.float64())), pa.array([good])], names=["origin", "tile", "colour", "decoded"]
                )

    made = files.mapInArrow(run, "origin string, tile array<double>, colour array<double>, decoded boolean")
    named = made.withColumn("filename", F.element_at(F.split("origin", "/"), -1)).drop("origin")
    mean = F.aggregate("tile", F.lit(0.0), lambda a, v: a + v) / F.size("tile")
    return numbered(named, ["filename"], "frame_id").withColumn("brightness", mean)


def decoded(h: int, w: int, channels: int, data: bytes | None, side: int, colour: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Grey and colour tile of raw pixels (rows of blue, green, red, or grey); zeros if there are none."""
    if not data or h <= 0 or w <= 0:
        return np.zeros((side, side)), np.zeros((colour, colour, 3)), False
    px = np.frombuffer(data, np.uint8).reshape(h, w, channels).astype(float)
    px = np.repeat(px, 3, axis=2) if channels == 1 else px[:, :, :3]
    grey = np.round(px @ np.array([0.114, 0.587, 0.299]))
    return np.round(area_resize(grey, side)), np.round(np.stack([area_resize(px[:, :, c], colour) for c in range(3)], axis=2)), True


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """filename, label of a flat JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,long>")).alias("filename", "label"))


def write_label_map(labels: DataFrame, path: str) -> None:
    """(filename, label) as lines of JSON objects with one entry each."""
    labels.select(F.to_json(F.create_map("filename", F.col("label").cast("long"))).alias("value")).write.text(path)


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,long>")).alias("filename", "label"))


def write_cache(frames: DataFrame, path: str) -> None:
    frames.write.parquet(path)


def with_colours(frames: DataFrame, colours: DataFrame) -> DataFrame:
    """frames with colour by filename; if any frame has none, no frame has."""
    both = frames.drop("colour").join(colours.select("filename", "colour"), "filename", "left")
    whole = both.agg(F.count(F.when(F.col("colour").isNull(), 1)).alias("n")).first()["n"] == 0
    return both if whole else both.withColumn("colour", F.lit(None).cast("array<double>"))


def chunks(groups: DataFrame, frames: int = 6000) -> DataFrame:
    """group_id, chunk of (group_id, n): whole groups in their order, about so many frames to a chunk."""
    from bracketry.operators.ranking import running

    return running(groups, ["group_id"], F.col("n"), "before").select("group_id", F.floor(F.col("before") / frames).cast("long").alias("chunk"))
