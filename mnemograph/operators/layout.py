"""Layouts: overlapping rectangles, and scenes that are referenced but missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the smaller width and height, the part that must overlap (fixed value).
SHARE = 0.35


def overlapping(rects: DataFrame, group: str, cell: float = 100.0) -> DataFrame:
    """(group, a, b) of rectangles (group, rect_id, x0, y0, x1, y1) that overlap by more than ``SHARE`` of the
    smaller width and of the smaller height; a < b.

    An equi-join on grid cells: a pair counts in the first cell that both lie in. Empty rectangles take no part.
    """
    sound = rects.where((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    placed = sound.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    side = lambda n: placed.select(F.col(group).alias("g"), "cx", "cy", *(F.col(c).alias(f"{c}_{n}") for c in ("rect_id", "x0", "y0", "x1", "y1")))
    both = side("a").join(side("b"), ["g", "cx", "cy"]).where("rect_id_a < rect_id_b")
    first = (F.col("cx") == F.floor(F.greatest("x0_a", "x0_b") / cell)) & (F.col("cy") == F.floor(F.greatest("y0_a", "y0_b") / cell))

    def enough(lo: str, hi: str) -> Column:
        shared = F.least(f"{hi}_a", f"{hi}_b") - F.greatest(f"{lo}_a", f"{lo}_b")
        return shared > SHARE * F.least(F.col(f"{hi}_a") - F.col(f"{lo}_a"), F.col(f"{hi}_b") - F.col(f"{lo}_b"))

    return both.where(first & enough("x0", "x1") & enough("y0", "y1")).select(F.col("g").alias(group), F.col("rect_id_a").alias("a"), F.col("rect_id_b").alias("b"))


def coverage(referenced: DataFrame, existing: DataFrame, planned: DataFrame, group: str, key: str) -> DataFrame:
    """(group, planned, built, missing, ok): referenced scenes that don't exist, and whether as many are
    built as planned. The three tables have (group, key); the first may repeat."""
    own = referenced.select(group, key).distinct()
    missing = own.join(existing.select(group, key).distinct(), [group, key], "left_anti").groupBy(group).agg(F.count("*").alias("missing"))
    built = own.groupBy(group).agg(F.count("*").alias("built"))
    plan = planned.groupBy(group).agg(F.count("*").alias("planned"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    each = plan.join(built, group, "full_outer").join(missing, group, "left").select(group, none("planned"), none("built"), none("missing"))
    return each.withColumn("ok", (F.col("missing") == 0) & (F.col("built") > 0) & (F.col("built") >= F.col("planned")))
