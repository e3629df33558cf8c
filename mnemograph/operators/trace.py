"""Session traces: turns, tool results, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.session import checkpointed


def turns(rows: DataFrame, key: str, order: str, prompt: Column) -> DataFrame:
    """``rows`` with ``turn_no``: a prompt opens one; rows before any prompt are in turn 0."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("turn_no", F.sum(prompt.cast("int")).over(w))


def with_results(calls: DataFrame, results: DataFrame, call: str = "call_id", line: str = "line_no", value: str = "result") -> DataFrame:
    """Calls with their result; of several the last line's."""
    last = results.groupBy(call).agg(F.max_by(value, line).alias(value))
    return calls.join(last, call, "left")


def user_ancestors(nodes: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, ancestor) from (id, parent, is_user): the nearest user row at or above each row; null without
    one or in a cycle. Pointers double each round, so depth d takes log2(d) joins; n rows have no chain
    longer than n, so what is open after log2(n) + 1 rounds leads into a cycle. ``most_rounds`` covers depths up to
    2 ** ``most_rounds``."""
    at = checkpointed(nodes.select("id", F.when(F.col("is_user"), F.col("id")).alias("ancestor"), F.when(~F.col("is_user"), F.col("parent")).alias("up")))
    for _ in range(min(most_rounds, at.count().bit_length() + 1)):
        if not at.where(F.col("ancestor").isNull() & F.col("up").isNotNull()).limit(1).count():
            break
        # rows that are done need no partner, and stay as they are
        open_, done = at.where(F.col("ancestor").isNull() & F.col("up").isNotNull()), at.where(F.col("ancestor").isNotNull() | F.col("up").isNull())
        above = at.select(F.col("id").alias("up"), F.col("ancestor").alias("a2"), F.col("up").alias("up2"))
        moved = open_.join(above, "up", "left").select("id", F.col("a2").alias("ancestor"), F.when(F.col("a2").isNull(), F.col("up2")).alias("up"))
        at = checkpointed(done.unionByName(moved))
    return at.select("id", "ancestor")


def carried_label(blocks: DataFrame, key: str, order: str, label: Column, is_image: Column) -> DataFrame:
    """``blocks`` with ``caption``: an image's is the text just before it where that is a label."""
    w = Window.partitionBy(key).orderBy(order)
    return blocks.withColumn("caption", F.when(is_image, F.lag(label).over(w)))


def capped_images(blocks: DataFrame, key: str, order: str, is_image: Column, most: int) -> DataFrame:
    """The first ``most`` images of each stream and all other blocks (a feature's limit)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("__n", F.sum(is_image.cast("int")).over(w)).where(~is_image | (F.col("__n") <= most)).drop("__n")
