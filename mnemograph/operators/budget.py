"""Streams of frames cut down to a byte budget, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.operators.rank import running_sum
from mnemograph.session import checkpointed


def _numbered(frames: DataFrame, key: str, order: str) -> DataFrame:
    """Frames with ``__pos``, 0-based within their stream."""
    return running_sum(frames, [key], order, F.lit(1), "__pos").withColumn("__pos", F.col("__pos") - 1)


def _totals(frames: DataFrame, key: str, size: str) -> DataFrame:
    return frames.groupBy(key).agg(F.count("*").alias("__n"), F.sum(size).alias("__total"))


def _first_that(test, near: Column) -> Column:
    """The integer at most one away from ``near`` that passes ``test``, else null."""
    return F.coalesce(*(F.when(test(near + d), near + d) for d in (-1, 0, 1)))


def thinned(frames: DataFrame, key: str, order: str, size: str, budget: int, least: int = 2) -> DataFrame:
    """``frames`` whose sizes fit ``budget`` in each stream: of n frames max(least, n * budget / total) are kept, evenly,
    and then frames are taken off the end until the sum fits or ``least`` are left. Streams that fit stay whole.

    A frame's place among those kept follows from its own place, and what is taken off from a running sum.
    """
    rows = _numbered(frames, key, order).join(_totals(frames, key, size), key)
    over = F.col("__total") > budget
    keep = F.greatest(F.lit(least), (F.col("__n") * budget / F.col("__total")).cast("long"))
    step = F.col("__n") / F.col("__keep")
    place = lambda i: F.least(F.col("__n") - 1, F.floor(i * step))
    at = _first_that(lambda i: (i >= 0) & (i < F.col("__keep")) & (place(i) == F.col("__pos")), F.floor(F.col("__pos") / step))
    rows = rows.withColumn("__keep", keep).withColumn("__at", F.when(over, at).otherwise(F.col("__pos"))).where("__at is not null")
    summed = running_sum(rows, [key], "__at", F.col(size), "__upto")
    fits = (F.col("__upto") <= budget) | (F.col("__at") < least) | ~over
    return summed.where(fits).select(*frames.columns, F.col("__at").alias("place"))


def resampled(frames: DataFrame, key: str, order: str, size: str, budget: int, least: int = 2) -> DataFrame:
    """``frames`` resampled evenly from first to last until each stream's sizes fit ``budget`` or ``least`` are left.

    A round takes max(least, n * budget / total) of a stream's n frames, so each makes the streams that don't fit
    shorter, and streams that do are done; a round costs one join with the streams' sums.
    """
    rows, done = checkpointed(_numbered(frames, key, order)), None
    while True:
        rows = rows.join(_totals(rows, key, size), key)
        open_ = (F.col("__total") > budget) & (F.col("__n") > least)
        fits = rows.where(~open_).drop("__n", "__total")
        done = fits if done is None else done.unionByName(fits)
        rows = rows.where(open_)
        if rows.isEmpty():
            return done.select(*frames.columns, F.col("__pos").alias("place"))
        keep = F.greatest(F.lit(least), (F.col("__n") * budget / F.col("__total")).cast("long"))
        step = (F.col("__n") - 1) / (F.col("__keep") - 1)
        at = _first_that(lambda i: (i >= 0) & (i < F.col("__keep")) & (F.bround(i * step) == F.col("__pos")), F.floor(F.col("__pos") / step))  # noqa: B023
        at = F.when(F.col("__keep") > 1, at).when(F.col("__pos") == 0, F.lit(0))
        rows = rows.withColumn("__keep", keep).withColumn("__pos", at).where("__pos is not null").drop("__n", "__total", "__keep")
        rows, done = checkpointed(rows), checkpointed(done)
