"""Beat grids, loudness, silence, picture statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.operators.rank import running_count


def beat_fit(beats: DataFrame, key: str) -> DataFrame:
    """(key, t0, period, bpm, worst_ms, trusted) of beats (key, i, t): a least-squares line."""
    fit = beats.groupBy(key).agg(F.regr_slope("t", "i").alias("period"), F.regr_intercept("t", "i").alias("t0"))
    off = beats.join(fit, key).groupBy(key).agg(F.first("t0").alias("t0"), F.first("period").alias("period"), (F.max(F.abs(F.col("t") - F.col("t0") - F.col("i") * F.col("period"))) * 1000).alias("worst_ms"))
    return off.select(key, "t0", "period", (60 / F.col("period")).alias("bpm"), "worst_ms", (F.col("worst_ms") <= 15).alias("trusted"))


def envelope(samples: DataFrame, key: str, window: int) -> DataFrame:
    """(key, win, rms) of samples (key, i, x): root mean squares of padded windows over the largest."""
    rms = samples.groupBy(key, F.floor(F.col("i") / window).alias("win")).agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / window).alias("r"))
    peak = rms.groupBy(key).agg(F.max("r").alias("peak"))
    return rms.join(peak, key).select(key, "win", F.when(F.col("peak") > 0, F.col("r") / F.col("peak")).otherwise(0.0).alias("rms"))


def silences(levels: DataFrame, key: str, order: str, value: str, below: float, least: int) -> DataFrame:
    """(key, first, last, n): runs of ``least`` or more consecutive rows under ``below``, by the integer ``order``.

    The rows of a run have the same number of other rows before them, so a key isn't one task's.
    """
    low = F.coalesce(F.col(value) < below, F.lit(False))
    counted = running_count(levels.select(key, order, low.alias("low")), [key], order, ~F.col("low"), "g")
    runs = counted.where("low").groupBy(key, "g")
    return runs.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("g")


def picture_stats(frames: DataFrame, key: str, depth: int = 8) -> DataFrame:
    """Mean luma, luma range and saturation of frames (y_avg, y_min, y_max, sat_avg), from 0 to 1."""
    top = float(2**depth - 1)
    return frames.groupBy(key).agg((F.avg("y_avg") / top).alias("y_mean"), ((F.avg("y_max") - F.avg("y_min")) / top).alias("y_range"), (F.avg("sat_avg") / top).alias("sat_mean"))


def clip_clock(clips: DataFrame, key: str, order: str, pause: float) -> DataFrame:
    """Clips (duration) with their start: all durations and pauses before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return clips.withColumn("start", F.round(F.coalesce(F.sum(F.col("duration") + pause).over(w), F.lit(0.0)), 2))


def strongest(beats: DataFrame, n: int, energy: str = "energy", at: str = "t") -> DataFrame:
    """The ``n`` beats of most energy, in time order; ties to the earlier one."""
    return beats.orderBy(F.col(energy).desc(), at).limit(n).orderBy(at)
