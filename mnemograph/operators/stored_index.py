"""An inverted index on disk: postings by term in ranges of nodes, each with the best it can score.

``append`` numbers the nodes of a batch (a segment) on from those stored and writes three tables under a folder:
``nodes`` (ord, node_id, node_type, dl), ``stats`` (segment, n, sum_dl, end) and ``postings``. A row of postings
is a term in a range of ``SPAN`` node numbers: its nodes, their counts and lengths as arrays, and the highest count
and least length among them. Rows lie in buckets by the term's hash, sorted by term, so a query opens the buckets
of its terms and, by the column index, the pages of these.

A score's part grows with the count and falls with the length, so a row's highest count and least length bound
it under any statistics, and a range's bounds add up over terms. ``search`` scores the ranges with the k highest bounds,
and then only those whose bound reaches the k-th score found: the result is exact. Statistics are
summed over segments when asked, so they are right as soon as a segment is written; ``compacted`` rewrites many
segments as one.

Defined cases: a null text is empty and counts as a node; null and repeated ids are nodes of their own; ties go to the
smaller id; a query without tokens, or an index without nodes, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemograph.functions.text import tokens
from mnemograph.operators.index import K1, B, of_types, query_terms
from mnemograph.operators.rank import global_rank
from mnemograph.session import spread

#: Nodes of a range; buckets of terms; what two scores that count as equal may differ by.
SPAN, BUCKETS, SLACK = 256, 32, 1e-6
POSTINGS = "term string, range long, n int, most int, least int, ord array<long>, tf array<int>, dl array<int>"


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def _written(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{table}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append(nodes: DataFrame, path: str, id_col: str = "node_id", text_col: str = "text", type_col: str | None = "node_type") -> int:
    """Add ``nodes`` to the index at ``path`` as a segment and return its number. Statistics are written last, and
    what has none is no part of the index, so a run that was lost leaves nothing behind."""
    spark = nodes.sparkSession
    stats = _written(spark, path, "stats")
    last = stats.agg(F.max("segment").alias("segment"), F.max("end").alias("end")).first() if stats is not None else None
    segment = 0 if last is None or last["segment"] is None else last["segment"] + 1
    # a segment starts a range of its own
    first = 0 if segment == 0 else -(-last["end"] // SPAN) * SPAN
    kind = F.col(type_col) if type_col else F.lit("")
    texts = spread(nodes.select(F.col(id_col).alias("node_id"), kind.cast("string").alias("node_type"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    # tokens hold no blanks, and one text of them is much smaller than their array
    found = tokens(F.col("text"))
    ranked = global_rank(texts, F.col("node_id"), name="ord", shown=["node_id", "node_type", F.array_join(found, " ").alias("words"), F.size(found).alias("dl")]).withColumn("ord", F.col("ord") + first)
    ranked.select("ord", "node_id", "node_type", "dl").write.mode("overwrite").parquet(f"{path}/nodes/segment={segment}")
    total = spark.read.schema("dl int").parquet(f"{path}/nodes/segment={segment}").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("sum_dl")).first()
    # a range's words meet once, as texts, and are counted where they are
    met = ranked.where("dl > 0").select(F.floor(F.col("ord") / SPAN).alias("range"), "ord", "dl", "words")
    _write_postings(met.groupBy("range").applyInArrow(_postings, POSTINGS), f"{path}/postings/segment={segment}")
    one = spark.createDataFrame([(total["n"], total["sum_dl"], total["n"] + first)], "n long, sum_dl long, end long")
    one.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/segment={segment}")
    return segment


def _postings(nodes: pa.Table) -> pa.Table:
    """The rows of postings of a range's nodes (range, ord, dl, words)."""
    nodes = nodes.sort_by("ord").combine_chunks()
    words = pc.split_pattern(nodes["words"].combine_chunks().cast(pa.large_string()), " ")
    of, coded = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words).dictionary_encode()
    # a term's nodes in their order
    keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(nodes) + of, return_counts=True)
    at, starts = keys % len(nodes), np.flatnonzero(np.r_[True, np.diff(keys // len(nodes)) > 0])
    tf, dl, order = tf.astype(np.int32), nodes["dl"].to_numpy()[at].astype(np.int32), nodes["ord"].to_numpy()[at]
    ends = np.r_[starts, len(keys)].astype(np.int32)
    listed = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (order, tf, dl)]
    range_ = np.full(len(starts), nodes["range"][0].as_py())
    columns = [coded.dictionary.cast(pa.string()), range_, np.diff(ends), np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts), *listed]
    return pa.table(columns, names=["term", "range", "n", "most", "least", "ord", "tf", "dl"])


def _write_postings(rows: DataFrame, path: str) -> None:
    rows = rows.withColumn("bucket", _bucket(F.col("term")))
    rows.repartition("bucket").sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(path)


def compacted(spark: SparkSession, path: str, target: str) -> None:
    """The index at ``path`` as one segment at ``target``; numbers stay, so postings are only put together."""
    stats, segments = _stats(spark, path)
    live = F.col("segment").isin(segments)
    spark.read.parquet(f"{path}/nodes").where(live).drop("segment").write.mode("overwrite").parquet(f"{target}/nodes/segment=0")
    rows = spark.read.parquet(f"{path}/postings").where(live).drop("segment")
    rows.repartition("bucket").sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/postings/segment=0")
    end = spark.read.parquet(f"{path}/stats").agg(F.max("end").alias("e")).first()["e"] or 0
    one = spark.createDataFrame([(stats["n"], stats["sum_dl"], end)], "n long, sum_dl long, end long")
    one.write.mode("overwrite").parquet(f"{target}/stats/segment=0")


def _stats(spark: SparkSession, path: str) -> tuple[dict, list[int]]:
    """Sums over the segments, which have a row each, and the segments that are whole."""
    stats = _written(spark, path, "stats")
    rows = [] if stats is None else stats.collect()
    return {"n": sum(r["n"] for r in rows), "sum_dl": sum(r["sum_dl"] for r in rows)}, sorted(r["segment"] for r in rows)


def term_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, n) of all terms: in how many nodes, and how often."""
    stats, segments = _stats(spark, path)
    if not stats["n"]:
        return spark.createDataFrame([], "term string, df long, n long")
    rows = spark.read.parquet(f"{path}/postings").where(F.col("segment").isin(segments))
    return rows.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))


def _part(tf: Column, dl: Column, weight: Column, average: float) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _idf(n: float, df: float) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1)


class Search:
    """``result`` (node_id, bm25), the ``k`` best; ``ranges`` with one of the terms and how many were ``read``."""

    def __init__(self, spark: SparkSession, path: str, query: str, k: int, node_types: list[str] | None = None) -> None:
        self.k, self.ranges, self.read = k, 0, 0
        terms, (stats, segments) = query_terms(query), _stats(spark, path)
        live = F.col("segment").isin(segments)
        nodes = _written(spark, path, "nodes")
        if not terms or not stats["n"]:
            kind = "long" if nodes is None else nodes.schema["node_id"].dataType.simpleString()
            self.result = spark.createDataFrame([], f"node_id {kind}, bm25 double")
            return
        nodes = nodes.where(live)
        posts = spark.read.parquet(f"{path}/postings").where(live & F.col("bucket").isin(sorted({crc32(t.encode()) % BUCKETS for t in terms})) & F.col("term").isin([*terms]))
        average = stats["sum_dl"] / stats["n"] or 1.0
        found = {r["term"]: r["df"] for r in posts.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # the query's terms
        weights = {t: times * _idf(stats["n"], found[t]) for t, times in terms.items() if t in found}
        if not weights:
            self.result = nodes.where("false").select("node_id", F.lit(0.0).alias("bm25"))
            return
        weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("term")]
        bounds = posts.groupBy("range").agg(F.sum(_part(F.col("most"), F.col("least"), weight, average)).alias("bound"))

        def scored(of: DataFrame) -> DataFrame:
            each = of.select(F.explode(F.arrays_zip("ord", "tf", "dl")).alias("p"), weight.alias("w"))
            out = each.groupBy("p.ord").agg(F.sum(_part(F.col("p.tf"), F.col("p.dl"), F.col("w"), average)).alias("bm25"))
            return out.join(nodes.where(of_types(nodes, node_types)).select("ord"), "ord", "left_semi") if node_types else out

        # the k ranges with the highest bounds give a score that k nodes reach
        first = bounds.orderBy(F.desc("bound"), "range").limit(k).collect()
        heads = [r["range"] for r in first]
        best = scored(posts.where(F.col("range").isin(heads))).orderBy(F.desc("bm25"), "ord").limit(k).collect()
        floor = best[-1]["bm25"] - SLACK if len(best) == k else float("-inf")
        open_ = bounds.where((F.col("bound") >= floor) & ~F.col("range").isin(heads)).select("range")
        self.ranges, self.read, self._bounds, self._open = None, None, bounds, open_
        rest = posts.join(open_, "range", "left_semi")
        all_ = scored(posts.where(F.col("range").isin(heads))).unionByName(scored(rest)).where(F.col("bm25") >= floor)
        self._heads = len(heads)
        self.result = all_.join(nodes.select("ord", "node_id"), "ord").select("node_id", "bm25")

    def count(self) -> tuple[int, int]:
        """(ranges with a term, ranges read)."""
        if self.ranges is None:
            self.ranges, self.read = self._bounds.count(), self._heads + self._open.count()
        return self.ranges, self.read


def search(spark: SparkSession, path: str, query: str, k: int, node_types: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """The ``k`` best (node_id, bm25), ties to the smaller id; ``digits``: scores are rounded before they are ranked."""
    found = Search(spark, path, query, k, node_types).result
    if digits is not None:
        found = found.withColumn("bm25", F.round("bm25", digits))
    return found.orderBy(F.desc("bm25"), "node_id").limit(k)


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, rank, node_id, bm25), the ``k`` best of each of (query_id, query), over all nodes with one of its words.

    Terms meet their postings by ranges, so what is shuffled is a row a query, term and range, and a query's nodes
    are summed within their range.
    """
    stats, segments = _stats(spark, path)
    live = F.col("segment").isin(segments)
    if not stats["n"]:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, node_id long, bm25 double")
    average, n = stats["sum_dl"] / stats["n"] if stats["n"] and stats["sum_dl"] else 1.0, float(stats["n"])
    asked = queries.select("query_id", F.explode(tokens(F.coalesce(F.col("query"), F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    posts = spark.read.parquet(f"{path}/postings").where(live)
    df = posts.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = asked.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("w"))
    pairs = posts.select("term", "range", "ord", "tf", "dl").join(weighed, "term")
    each = pairs.select("query_id", "w", F.explode(F.arrays_zip("ord", "tf", "dl")).alias("p"))
    scored = each.groupBy("query_id", "p.ord").agg(F.sum(_part(F.col("p.tf"), F.col("p.dl"), F.col("w"), average)).alias("bm25"))
    if digits is not None:
        scored = scored.withColumn("bm25", F.round("bm25", digits))
    # all that tie with a query's last place get their ids, then ties go by these
    by_score = Window.partitionBy("query_id").orderBy(F.desc("bm25"))
    near = scored.withColumn("at", F.rank().over(by_score)).where(F.col("at") <= k).drop("at")
    named = near.join(spark.read.parquet(f"{path}/nodes").where(live).select("ord", "node_id"), "ord")
    by_id = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "node_id")
    return named.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k).select("query_id", "rank", "node_id", "bm25")
