"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where that is unset on a local master (tests) is a folder of our own made and set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="mnemograph-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of ``shared_path`` that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored in the block are deleted at its end, but for those stored with ``keep``."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_path(spark, path)


def store(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    ``keep``: the table outlives the innermost ``scratch`` block and goes with the one around it.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    held = _scratch[: len(_scratch) - keep]
    if held:
        held[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


_caches: dict[str, Callable[[], None]] = {}
_owner = [""]


def take_over(owner: str, clear: Callable[[], None]) -> None:
    """Called in a Python worker before ``owner`` uses its cache: other operators' caches are emptied, so a
    worker that serves several stages holds one of them at a time."""
    _caches[owner] = clear
    if _owner[0] != owner:
        for name, empty in _caches.items():
            if name != owner:
                empty()
        pa.default_memory_pool().release_unused()
        _owner[0] = owner


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Keys that more than this part of all rows hold are joined by broadcast.
HOT_PART = 1000


def join_apart(rows: DataFrame, key: str, table: DataFrame, total: int, size: str, wanted: Column) -> DataFrame:
    """Left join with ``table``, unique by ``key``, whose ``size`` says how many of the ``total`` rows hold the key.

    Keys with over ``total / HOT_PART`` rows, fewer than HOT_PART of them, come by broadcast; rows that need no other
    key go to partitions by a hash of their own, so no partition holds a hot key's rows.
    """
    values = [c for c in table.columns if c not in (key, size)]
    hot, cold = F.col(size) * HOT_PART > total, F.col(size) * HOT_PART <= total
    first = table.where(hot).select(key, *[F.col(c).alias(f"hot_{c}") for c in values], F.lit(True).alias("is_hot"))
    rows = rows.join(F.broadcast(first), key, "left").withColumn("apart", ~wanted | F.coalesce("is_hot", F.lit(False)))
    rows = rows.withColumn("to", F.when(F.col("apart"), F.xxhash64(*rows.columns).cast("string")).otherwise(F.col(key)))
    rest = table.where(cold).select(F.lit(False).alias("apart"), F.col(key).alias("to"), *[F.col(c).alias(f"own_{c}") for c in values])
    rows = rows.join(rest, ["apart", "to"], "left")
    for c in values:
        rows = rows.withColumn(c, F.coalesce(f"hot_{c}", f"own_{c}"))
    return rows.drop("apart", "to", "is_hot", *[f"{x}_{c}" for c in values for x in ("hot", "own")])


def remainder(id_col: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids give null."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % mod


def stable(df: DataFrame, label: str = "stable") -> DataFrame:
    """``df`` with its rows in an order that is the same whenever the plan runs again.

    A scan has one; where a shuffle or Python could change it between runs, the rows are stored.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    return store(df, label) if any(x in plan for x in ("Exchange", "Python", "Pandas", "Arrow")) else df


def numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text): a number for each row that stays the same whenever the plan runs again."""
    return stable(two(df, id_col, text_col), "numbered").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def smallest_reachable(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, from links (a, b) of longs.

    Alternating large and small stars: every round each node points its neighbours to the smallest
    one near it, so a component becomes a star in a logarithmic number of rounds. A node's
    neighbours are never gathered; only their minimum is.
    """
    edges = store(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: larger neighbours of each node go to its minimum
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself go to the least of them
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a")
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_min.select("a", F.col("m").alias("b")))
        after = store(after.where(F.col("a") != F.col("b")).distinct(), "links")
        # done when every node has one edge and no root has an edge of its own
        twice = after.groupBy("a").count().where(F.col("count") > 1).limit(1).count()
        chained = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        edges = after
        if not twice and not chained:
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, root) of those in ``roots`` and more ``links`` (a, b): only the roots that new
    links join are looked at again."""
    if roots is None:
        return smallest_reachable(links)
    for c in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    new = store(links.where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "joins")
    if new.isEmpty():
        return roots
    over = smallest_reachable(new).select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    lone = over.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return store(known.unionByName(lone), "roots")
