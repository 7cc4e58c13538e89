"""Column functions on frames: exposure classes, capture keys, cosines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exposure_class(b: Column) -> Column:
    """bright (under 30), dark (over 225), well (70 to 185), else null: which extreme a clipped frame keeps."""
    return F.when(b < 30, "bright").when(b > 225, "dark").when(b.between(70, 185), "well")


def stem(filename: Column) -> Column:
    """Without extension (from the last dot) and without a g<number>_ tag."""
    return F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"^g\d+_", "")


def capture_prefix(filename: Column) -> Column:
    """What is before the trailing number; null without one."""
    s = stem(filename)
    return F.when(s.rlike(r"\d$"), F.regexp_replace(s, r"\d+$", ""))


def capture_number(filename: Column) -> Column:
    s = stem(filename)
    return F.when(s.rlike(r"\d$"), F.regexp_extract(s, r"(\d+)$", 1).cast("long"))


def last_number(filename: Column) -> Column:
    """The last number of the whole name without any digit after it but an extension's; 0 if there is none."""
    found = F.regexp_extract(filename, r"(\d+)\D*$", 1)
    return F.when(found == "", 0).otherwise(found.cast("long"))


def sequence_key(filename: Column) -> tuple[Column, Column]:
    """Prefix and number, or the whole name and -1 without a trailing number."""
    return F.coalesce(capture_prefix(filename), filename), F.coalesce(capture_number(filename), F.lit(-1))


def number_or_minus_one(filename: Column) -> Column:
    return F.coalesce(capture_number(filename), F.lit(-1))


def prefix_or_stem(filename: Column) -> Column:
    return F.coalesce(capture_prefix(filename), stem(filename))


def group_of_name(filename: Column) -> Column:
    """The id in a leading g<id>_ tag; null without one."""
    found = F.regexp_extract(filename, r"^g(\d+)_", 1)
    return F.when(found != "", found)


def clipped(b: Column, lo: float, hi: float) -> Column:
    return (b < lo) | (b > hi)


def well(b: Column, lo: float, hi: float) -> Column:
    return b.between(lo, hi)


# fixed values: clipped and well exposed bands of the passes
CLIPPED_BANDS = {"orphan": (45, 210), "blank": (12, 245), "hard": (30, 225)}
WELL_BANDS = {"merge": (50, 205), "split": (55, 200), "anchor": (50, 200), "drift": (45, 215), "mid": (70, 185), "scene": (45, 205)}


def category(reason: Column) -> Column:
    """Why a group is left out, by the words of its reason."""
    r = F.lower(reason)
    return F.when(r.startswith("information-limited"), "Information-limited").when(r.contains("duplicate-frame"), "Duplicate frame shared across groups").when(reason.isNotNull(), "Mislabeled ground truth (multi-scene)")
