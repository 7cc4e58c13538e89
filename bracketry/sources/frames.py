"""Sources and sinks: frames (small grey tiles with filenames), manifests, excluded groups, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.operators.ranking import numbered

#: Gains at which the bracket fixture exposes each scene.
GAINS = (0.15, 0.5, 1.0, 1.9)
SUFFIXES = r"(?i)\.(jpg|jpeg|png)$"


def bracket_frames(embeddings: DataFrame) -> DataFrame:
    """frame_id, scene, lvl, filename, tile, brightness: each embedding as an 8x8 tile at four exposures."""
    levels = F.array(*(F.struct(F.lit(k).alias("lvl"), F.lit(g).alias("g")) for k, g in enumerate(GAINS)))
    each = embeddings.select("vec_id", "embedding", F.explode(levels).alias("e"))
    tile = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((128 + 300 * x.cast("double")) * F.col("e.g")).cast("double"))))
    frames = each.select((F.col("vec_id") * 4 + F.col("e.lvl")).alias("frame_id"), F.col("vec_id").alias("scene"), F.col("e.lvl").alias("lvl"), tile.alias("tile"))
    mean = F.aggregate("tile", F.lit(0.0), lambda a, v: a + v) / F.size("tile")
    return frames.withColumns({"filename": F.format_string("IMG_%05d.jpg", "frame_id"), "brightness": mean})


def pixels(frames: DataFrame) -> DataFrame:
    """frame_id, scene, p, v in long form."""
    return frames.select("frame_id", "scene", F.posexplode("tile").alias("p", "v"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, content of the images of a flat folder; frame order is the order of filenames."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("path").rlike(SUFFIXES))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """filename, group_id by header, whatever the column order; every row stays, as in an answer key."""
    return spark.read.option("header", True).csv(path).select("filename", "group_id")


def last_wins(rows: DataFrame) -> DataFrame:
    """Of a repeated filename of predictions (filename, group_id) the last row of the file."""
    return rows.withColumn("at", F.monotonically_increasing_id()).groupBy("filename").agg(F.max_by("group_id", "at").alias("group_id"))


def excluded(spark: SparkSession, path: str) -> DataFrame:
    """group_id of each group of an excluded-groups JSON file ({"groups": {id: ...}})."""
    kind = "groups map<string, struct<reason: string, frames: int, subscenes: int, category: string>>"
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode(F.map_keys("groups")).alias("group_id"))


def failures(spark: SparkSession, path: str) -> DataFrame:
    """group_id, category of a flat JSON object; keys that begin with _ are comments."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("group_id", "category"))
    return text.where(~F.col("group_id").startswith("_"))


def predictions(labels: DataFrame) -> DataFrame:
    """filename, group_id of (filename, label): groups numbered by their first filename, rows by group and filename."""
    first = labels.groupBy("label").agg(F.min("filename").alias("first"))
    return labels.join(numbered(first, ["first", "label"], "group_id"), "label").select("filename", F.col("group_id").cast("int").alias("group_id"))


def write_predictions(labels: DataFrame, path: str) -> int:
    out = predictions(labels)
    out.orderBy("group_id", "filename").write.option("header", True).csv(path)
    return out.count()
