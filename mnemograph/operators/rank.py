"""Ranks over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.session import checkpointed


def global_rank(df: DataFrame, *order: Column, name: str = "rank", shown: list[Column | str] | None = None) -> DataFrame:
    """``df`` with a 0-based row number by ``order``, which should have no ties; ``shown``, where given, takes the place of
    its columns once the rows are placed, so that what is computed is neither sampled nor moved.

    The rows are range-partitioned and sorted, and numbered within their partition; each partition
    then adds the rows before it. Only one row a partition is broadcast.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(placed.select(*(["*"] if shown is None else shown), F.monotonically_increasing_id().alias("__at")))
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__at", "__part", "__before")


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = 10_000) -> DataFrame:
    """``df`` with the sum of the integer ``value`` over its key's rows up to and with each row, by the integer ``order``.

    Rows are summed within blocks of ``order``; a block then adds its key's earlier blocks, of which there is one
    row each. So a key with many rows isn't one task's.
    """
    held = df.withColumn("__block", F.floor(F.col(order) / block)).withColumn("__value", F.coalesce(value.cast("long"), F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(*keys, "__block").agg(F.sum("__value").alias("__n")).select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumn("__n", F.sum("__value").over(within)).join(sums, [*keys, "__block"])
    return out.withColumn(name, F.col("__n") + F.col("__before")).drop("__block", "__value", "__n", "__before")


def running_count(df: DataFrame, keys: list[str], order: str, flag: Column, name: str, block: int = 10_000) -> DataFrame:
    """``df`` with the number of ``flag`` rows of its key up to and with each row, by the integer ``order``."""
    return running_sum(df, keys, order, flag.cast("int"), name, block)
