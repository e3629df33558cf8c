"""Interval joins by time buckets: an equi-join instead of comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.operators.rank import global_rank


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: float, closed: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose ranges overlap; touching ones only if ``closed``. ``keys``: equal columns besides.

    Each row goes to the buckets of ``width`` that its range meets, and a pair counts in the first
    bucket that both have, so no pair comes twice and none needs a distinct. Rows with a null or
    turned-round range have no partner. Other columns of both sides must differ in name.
    """
    (ls, le), (rs, re) = left_range, right_range
    rows = left.where(F.col(ls) <= F.col(le)).withColumn("__b", F.explode(_buckets(F.col(ls), F.col(le), width)))
    others = right.where(F.col(rs) <= F.col(re)).withColumn("__b", F.explode(_buckets(F.col(rs), F.col(re), width)))
    meets = (F.col(ls) <= F.col(re)) & (F.col(le) >= F.col(rs)) if closed else (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs))
    first = F.col("__b") == F.greatest(F.floor(F.col(ls) / width), F.floor(F.col(rs) / width))
    return rows.join(others, ["__b", *keys]).where(meets & first).drop("__b")


def overlap_counts(rows: DataFrame, id_col: str, start: str, end: str, key: str) -> DataFrame:
    """(id, n_overlaps): how many other rows of the same ``key`` each closed range meets.

    The starts up to a row's end, less the ends before its start, less the row itself. Starts and ends
    go into one order, starts first at equal times, so a point's place among all less its place among
    its own kind is the number of the other kind before it. What earlier keys add is the same in both
    numbers, as their ranges have ended. No pair is made. Rows with a null id, key or range or a
    turned-round range have no count; ids should be unique.
    """
    valid = rows.where(F.col(start) <= F.col(end)).where(F.col(key).isNotNull() & F.col(id_col).isNotNull())
    point = lambda kind, t: F.struct(F.lit(kind).alias("kind"), F.col(t).alias("t"))
    points = valid.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.explode(F.array(point(0, start), point(1, end))).alias("p")).select("id", "key", "p.kind", "p.t")
    placed = global_rank(points, F.col("key"), F.col("t"), F.col("kind"), F.col("id"), name="place")
    # by kind first: the starts' places come before the ends'
    own = global_rank(placed, F.col("kind"), F.col("key"), F.col("t"), F.col("id"), name="own")
    # ends' own places have all n starts before them, so the sum below misses the starts by n
    sums = own.groupBy("id").agg(F.sum(F.when(F.col("kind") == 1, F.col("place") - F.col("own")).otherwise(F.col("own") - F.col("place"))).alias("d"))
    return sums.crossJoin(F.broadcast(own.agg(F.count_if(F.col("kind") == 0).alias("n")))).select(F.col("id").alias(id_col), (F.col("d") + F.col("n") - 1).alias("n_overlaps"))


def at_times(macros: DataFrame, start: float = 0.0, end: float = 600.0, cutoff: float | None = None) -> DataFrame:
    """Macros (t_start, t_end) that meet a closed window, visible before ``cutoff``: a pushed filter."""
    found = macros.where((F.col("t_start") <= end) & (F.col("t_end") >= start))
    return found if cutoff is None else found.where(F.col("t_start") < cutoff)


def time_hits(macros: DataFrame, supers: DataFrame, start: float = 0.0, end: float = 600.0, cutoff: float | None = None) -> DataFrame:
    """``at_times`` with ``super_event``, the label of the super (super_id, label) that a macro's ``super_id`` names; '' without one."""
    labels = supers.groupBy("super_id").agg(F.max("label").alias("super_event"))
    return at_times(macros, start, end, cutoff).join(labels, "super_id", "left").withColumn("super_event", F.coalesce("super_event", F.lit("")))


def transcript_texts(macros: DataFrame, segments: DataFrame, width: float = 60.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(macro_id, asr_text): texts of segments (start_sec, end_sec, text) that overlap a macro, joined
    by a space in time order; a segment across a border is in both; without any it is ''. ``keys``: equal columns besides."""
    pairs = overlap_join(macros.select("macro_id", "t_start", "t_end", *keys), segments.select("start_sec", "end_sec", "text", *keys), ("t_start", "t_end"), ("start_sec", "end_sec"), width, closed=False, keys=keys)
    lines = pairs.groupBy("macro_id").agg(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "text"))).alias("s"))
    joined = lines.select("macro_id", F.array_join(F.transform("s", lambda x: F.trim(x["text"])), " ").alias("asr_text"))
    return macros.select("macro_id").join(joined, "macro_id", "left").select("macro_id", F.coalesce("asr_text", F.lit("")).alias("asr_text"))
