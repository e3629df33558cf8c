"""Token-ID output: ORC with run-length integers, row indexes and Bloom filters on document ids.

``write_token_orc`` range-partitions whole documents by id, encodes them and writes one ORC file a
range; ORC run-length encodes the ids, and each stripe has row indexes and a Bloom filter on
``doc_id``, so ``read_token_orc(..., doc_ids)`` skips stripes by metadata and full reads split by
stripe. ``start`` is kept within a part; ``token_index`` adds the parts' offsets, which are one row
a part.

Defined cases: a null or empty text has the end id only. Rows are ordered by doc_id (nulls first),
then by the text's hash, so rows with one id keep a fixed order up to equal texts; a repeated row is
written as often as it comes. An empty table gives an empty index. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemograph.llm.common import shared_path, two

STORED = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _encode(name: str, spaces: str, end_id: int, cache_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from mnemograph.llm.tokens import cached

        tok, part, total = cached(name, spaces, cache_bytes), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, batch.num_rows, 500):
                raw = [tok.encode(t) + end for t in texts.slice(lo, 500).to_pylist()]
                sizes = np.array([len(r) // 4 for r in raw], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, 500), pa.array(np.full(len(raw), part, dtype=np.int32)), pa.array(total + ends[:-1]), pa.array(sizes), ids],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                total += int(ends[-1])

    return run


def write_token_orc(df: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", spaces: str = "dropped", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, stripe_bytes: int = 16 << 20, index_stride: int = 1000, cache_bytes: int = 240 << 20) -> None:
    """Encode ``df`` and write it in ascending id order under ``path``; ``parts``: number of files."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = two(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    docs = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    (
        docs.select("doc_id", "text")
        .mapInArrow(_encode(tokenizer, spaces, end_id, cache_bytes), STORED)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids`` only theirs, found through stripe statistics and Bloom filters."""
    rows = spark.read.schema(STORED).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, at = np.asarray(ids.values, dtype="<u4"), np.asarray(ids.offsets)
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "start_in_part", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read from the files under ``path``."""
    rows = read_token_orc(spark, path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    crcs = rows.mapInArrow(_crc, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return crcs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_table(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to a fresh path of the shared folder and return its index, read from the files."""
    path = shared_path(df.sparkSession, "tokens")
    write_token_orc(df, path, **options)
    return token_index(df.sparkSession, path)
