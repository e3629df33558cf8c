"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into integers, ordered by length and cut into parts and buckets of similar length.
First every query meets the longest bucket of all: its k-th best score there is a threshold that holds
everywhere. Then queries, in blocks, go through every part, which a task holds while the blocks
pass by one at a time. In a part a query goes through the buckets from the longest down and keeps
its k best so far; the better of the k-th best score and the threshold gives a bucket's local
cosine threshold t = score / (|q| * longest in bucket). Above 1 the bucket is skipped. When t is high
enough, coordinate pruning keeps the vectors whose value at the query's strongest coordinate lies in
the interval that a cosine of t allows. From a lower t on, the query's stronger half of coordinates is its focus: a
vector stays if its product over the focus and the lengths of both rests can reach the score. Otherwise length
pruning keeps those long enough to reach the score. Products of what is left are computed in full, so the result is exact. A block of
queries is sent to the parts only whose longest vector one of its queries can reach. The tasks' winners are merged by rank.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; a
vec_id stands for one vector, so of rows that repeat an id the smallest vector (in array order)
counts and a query is never its own candidate; vectors of another dimension than the query's are no
candidates; null ids take no part; ties go to the smaller id; with fewer than k candidates all are
returned; empty tables give no rows. Other columns are ignored. Products are exact in 64-bit integers; vectors
whose lengths' product could pass 2**62 are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.llm.common import store

WINNERS = "query_id long, vec_id long, score long"
#: Score of a free place; its negative is still an int64.
NONE = -(1 << 62)
#: Rows of a part, of a bucket, of a query block and of the first bucket, which each task that ranks keeps.
PART_ROWS, BUCKET_ROWS, BLOCK_ROWS, HEAD_ROWS = 100_000, 4096, 2048, 256
#: Above this local cosine threshold a coordinate's feasible interval is narrow enough to pay.
COORDINATE_FROM = 0.7
#: From this threshold on a query's product over its focus, the stronger half of its coordinates, is computed first.
FOCUS_FROM, FOCUS_PART = 0.2, 0.5
#: Groups in which the longest vectors are found before the longest of all are.
HEAD_GROUPS = 16


class Best:
    """The k best candidates of each query of a block so far: score descending, then id."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), NONE, dtype=np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row for each of ``rows`` and a column for each of ``ids``."""
        k = self.score.shape[1]
        if len(ids) > 4 * k:  # a first cut that keeps every tie of the k-th best
            kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            some = (scores >= kth[:, None]).sum(axis=1)
            for size in np.unique(some):
                own = np.flatnonzero(some == size)
                cols = np.argpartition(-scores[own], size - 1, axis=1)[:, :size]
                self._merge(rows[own], np.take_along_axis(scores[own], cols, axis=1), ids[cols])
        elif len(ids):
            self._merge(rows, scores, np.broadcast_to(ids, scores.shape))

    def _merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        s, i = np.concatenate([self.score[rows], scores], axis=1), np.concatenate([self.id[rows], ids], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


def search_bucket(best: Best, queries: np.ndarray, query_ids: np.ndarray, q_len: np.ndarray, vectors: np.ndarray, ids: np.ndarray, lengths: np.ndarray, floor: np.ndarray | None = None) -> int:
    """Let one bucket (longest first) compete for the queries' k best places; ``floor``: scores below it
    can't be among them. Returns how many products were computed."""
    threshold = np.where(best.score[:, -1] == NONE, -np.inf, best.score[:, -1].astype(np.float64))
    threshold = threshold if floor is None else np.maximum(threshold, floor)
    reach = q_len * lengths[0]
    # a product can't pass |q||v|; the margin covers the rounding of the square roots
    alive = (threshold <= reach * (1 + 1e-9)) | (threshold <= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, threshold / reach, -np.inf)
    near = alive & (local >= COORDINATE_FROM)
    focused = alive & ~near & (local >= FOCUS_FROM)
    rest = np.flatnonzero(alive & ~near & ~focused)
    own, done = {int(v): j for j, v in enumerate(ids)}, 0
    largest = float(q_len.max(initial=0) * lengths[0])
    if largest >= 2.0**62:
        raise ValueError("products of these vectors don't fit into 64-bit integers")
    exact = largest < 2.0**53  # in float64, which is faster

    def offer(rows: np.ndarray, cols: np.ndarray) -> None:
        nonlocal done
        if not len(rows) or not len(cols):
            return
        done += len(rows) * len(cols)
        scores = (queries[rows] @ vectors[cols].T).astype(np.int64) if exact else queries[rows].astype(np.int64) @ vectors[cols].astype(np.int64).T
        at = {int(c): j for j, c in enumerate(cols)} if len(cols) < len(ids) else None
        for r, q in enumerate(query_ids[rows].tolist()):
            j = own.get(q)
            j = j if at is None or j is None else at.get(j)
            if j is not None:
                scores[r, j] = NONE
        best.add(rows, scores, ids[cols])

    for lo in range(0, len(rest), 256):  # length pruning: the least threshold of the block decides
        rows = rest[lo : lo + 256]
        least, longest = threshold[rows].min(), q_len[rows].max()
        n = len(ids) if least <= 0 or longest == 0 else int(np.searchsorted(-lengths, -least / longest * (1 - 1e-9), side="right"))
        offer(rows, np.arange(n))
    if focused.any():
        columns = np.ascontiguousarray(vectors.T)
        squares, whole = columns * columns, lengths * lengths
        m = max(1, int(len(columns) * FOCUS_PART))
        strongest = np.argsort(-np.abs(queries[focused]), axis=1, kind="stable")[:, :m]
        for r, f in zip(np.flatnonzero(focused), strongest, strict=True):
            q = queries[r, f]
            tail = np.sqrt(np.maximum(whole - squares[f].sum(axis=0), 0.0)) * np.sqrt(max(0.0, q_len[r] * q_len[r] - q @ q))
            # the margin covers the rounding of the roots and sums
            offer(np.array([r]), np.flatnonzero(q @ columns[f] + tail + 1e-9 * q_len[r] * lengths[0] >= threshold[r]))
    if near.any():
        unit = vectors / np.maximum(lengths, 1e-300)[:, None]
        for r in np.flatnonzero(near):  # coordinate pruning at the query's strongest coordinate
            q, t = queries[r] / q_len[r], min(local[r], 1.0)
            f = int(np.argmax(np.abs(q)))
            half = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(max(0.0, 1 - q[f] * q[f]))
            # cos >= t gives v_f between cos(a + b) and cos(a - b) with a = acos(q_f), b = acos(t)
            low = t * q[f] - half if q[f] > -t else -1.0
            high = t * q[f] + half if q[f] < t else 1.0
            offer(np.array([r]), np.flatnonzero((unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)))
    return done


HELD = "dim int, part int, ids binary, norms binary, matrix binary, floors binary"


def _blocks(rows: int):
    """Rows (dim, part, vec_id, ints, norm) to blocks of ``rows`` at most, longest first, matrices as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (dim, part), g in batch.to_pandas().groupby(["dim", "part"], sort=False):
                g = g.sort_values(["norm", "vec_id"], ascending=[False, True])
                for lo in range(0, len(g), rows):
                    x = g.iloc[lo : lo + rows]
                    blobs = [x["vec_id"].to_numpy(dtype="<i8").tobytes(), x["norm"].to_numpy(dtype="<f8").tobytes(), np.array(x["ints"].tolist(), dtype="<f8").tobytes(), None]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names=["dim", "part", "ids", "norms", "matrix", "floors"])

    return run


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        most = [float(np.frombuffer(x, "<f8")[0]) for x in batch.column("norms").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("part"), pa.array(most, pa.float64())], names=["dim", "part", "longest"])


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["norms"], "<f8"), np.frombuffer(row["matrix"], "<f8").reshape(-1, row["dim"])


def _passing(use):
    """Rows sorted by (dim, part, asks): a part's vectors are held while its query blocks pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["dim"], row["part"]) != key:
                    key, held = (row["dim"], row["part"]), []
                if row["asks"]:
                    held.sort(key=lambda x: -x[1][0])
                    yield use(row, held)
                else:
                    held.append(_opened(row))

    return run


def top_k(vectors: DataFrame, k: int = 5, is_query: Column | None = None, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", bucket_rows: int = BUCKET_ROWS, parts: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer products, exact.

    ``is_query``: condition on column ``vec_id``; by default ids divisible by 50. ``bucket_rows``:
    rows of a bucket at most. ``parts``: tasks that the vectors are dealt over, by default one for
    each ``PART_ROWS``.
    """
    spark = vectors.sparkSession
    # a count needs no column, so it is read from the files' footers
    n_parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // PART_ROWS))
    asked = is_query if is_query is not None else F.col("vec_id") % 50 == 0
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = raw.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    ints = sound.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale))).cast("array<double>").alias("ints"))
    one = ints.groupBy("vec_id").agg(F.min("ints").alias("ints"))
    base = one.select("vec_id", "ints", F.size("ints").alias("dim"), F.sqrt(F.aggregate("ints", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))

    longest_first = (F.col("dim"), F.col("norm").desc(), F.col("vec_id"))
    ordered = base.repartitionByRange(n_parts, *longest_first).sortWithinPartitions(*longest_first)
    # stored, as a part's number must be the same for its vectors and its longest
    buckets = store(ordered.select("dim", F.spark_partition_id().alias("part"), "vec_id", "ints", "norm").mapInArrow(_blocks(bucket_rows), HELD), "buckets")
    longest = buckets.select("dim", "part", "norms").mapInArrow(_longest, "dim int, part int, longest double").groupBy("dim", "part").agg(F.max("longest").alias("longest"))
    blocks = base.where(asked).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)).cast("int")).mapInArrow(_blocks(BLOCK_ROWS), HELD)

    def first_floor(row: dict, held: list) -> pa.RecordBatch:
        ids, norms, m = _opened(row)
        best = Best(len(ids), k)
        for own, lengths, matrix in held:
            search_bucket(best, m, ids, norms, matrix, own, lengths)
        floors = np.where(best.score[:, -1] == NONE, -np.inf, best.score[:, -1].astype("<f8")).astype("<f8")
        # vectors shorter than this are out of reach of all the block's queries
        with np.errstate(divide="ignore", invalid="ignore"):
            need = float(np.where(floors > 0, floors / norms, 0.0).min())
        cells = [(need, pa.float64()), (row["dim"], pa.int32()), (row["ids"], pa.binary()), (row["norms"], pa.binary()), (row["matrix"], pa.binary()), (floors.tobytes(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cells], names=["need", "dim", "ids", "norms", "matrix", "floors"])

    def search(row: dict, held: list) -> pa.RecordBatch:
        (ids, norms, m), best, floors = _opened(row), None, np.frombuffer(row["floors"], "<f8")
        best = Best(len(ids), k)
        for own, lengths, matrix in held:
            search_bucket(best, m, ids, norms, matrix, own, lengths, floors)
        real = (best.score != NONE) & (best.score >= floors[:, None])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(axis=1))), pa.array(best.id[real]), pa.array(best.score[real])], names=["query_id", "vec_id", "score"])

    def meeting(held: DataFrame, asking: DataFrame) -> DataFrame:
        both = held.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)))
        return both.repartition(n_parts, "dim", "part").sortWithinPartitions("dim", "part", "asks")

    # the longest bucket of each dimension, a copy for each group of query blocks
    head = base.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(HEAD_GROUPS)))
    for keys in (["dim", "group"], ["dim"]):
        head = head.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("norm").desc(), "vec_id"))).where(F.col("at") <= HEAD_ROWS)
    head = head.withColumn("part", F.lit(0)).select("dim", "part", "vec_id", "ints", "norm").mapInArrow(_blocks(HEAD_ROWS), HELD)
    head = head.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    floored = store(meeting(head, blocks).mapInArrow(_passing(first_floor), "need double, dim int, ids binary, norms binary, matrix binary, floors binary"), "floors")
    # the parts that a block can reach; a part is one row, so these may be broadcast
    reached = floored.join(F.broadcast(longest), (floored["dim"] == longest["dim"]) & (F.col("longest") * (1 + 1e-9) >= F.col("need"))).select(floored["dim"], "part", "ids", "norms", "matrix", "floors")
    winners = meeting(buckets, reached).mapInArrow(_passing(search), WINNERS)
    ranked = winners.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
