"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of ``window`` consecutive words of each item (an item of fewer words is one
window). Patterns of one length share a shift table on pairs of words: at each place the pair that
ends the window tells how far to skip; a shift of zero gives the bucket of patterns with that last
pair, and comparing the words confirms an occurrence.

Texts are lower-cased (A-Z) and words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

The tables are broadcast in blocks of about ``block_bytes`` of item text (an item isn't split). With one block a document
is finished in one pass; with more, each block searches all documents and the hits are joined.

Defined cases: a null, empty or wordless text has no hits and isn't contaminated; items without
words are no patterns; null and repeated doc_ids give a row each; items repeated under one id count
once; null item_ids are left out of lists and counts, but their words count as hit; empty tables work.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import fresh, store, take_over, two

#: Lower-cases A-Z; every other byte that no word holds becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class WuManber:
    """Shift and bucket tables for patterns of one length, in words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set]) -> None:
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.bucket[words[length - self.block :]].append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(place of the first word, items) of every occurrence."""
        n, m, shift, default = len(words), self.length, self.shift, self.default
        i = m
        if self.block == 1:
            for i, w in enumerate(words):
                for _, items in self.bucket.get((w,), ()):
                    yield i, items
            return
        while i <= n:
            key = (words[i - 2], words[i - 1])
            skip = shift.get(key, default)
            if skip:
                i += skip
                continue
            for pattern, items in self.bucket[key]:
                if pattern[0] == words[i - m] and pattern == tuple(words[i - m : i]):
                    yield i - m, items
            i += 1


def compile_items(items: list[tuple], window: int) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length[m][tuple(words[i : i + m])] |= set() if item_id is None else {str(item_id)}
    return [WuManber(m, found) for m, found in sorted(by_length.items())]


def scan(words: list[bytes], tables: list[WuManber]) -> tuple[np.ndarray, set]:
    """Which words are hit, and the items found."""
    steps, found = np.zeros(len(words) + 1, dtype=np.int64), set()
    for table in tables:
        for at, items in table.search(words):
            steps[at] += 1
            steps[at + table.length] -= 1
            found |= items
    return np.cumsum(steps)[:-1] > 0, found


def verdict(n_words: int, n_hit: int, found: set) -> tuple:
    names = sorted(found)
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words, names


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, cols, kinds)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"])


_compiled: dict[str, list[WuManber]] = {}


def _tables(key: str, shared, window: int) -> list[WuManber]:
    """The tables of one broadcast block, compiled once a worker."""
    take_over("decontaminate", _compiled.clear)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = compile_items(shared.value, window)
    return _compiled[key]


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, and whether it is contaminated."""
    spark = df.sparkSession
    docs = two(df, id_col, text_col)
    items = benchmark.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    if blocks <= 1:  # checked: at most block_bytes
        shared, key = spark.sparkContext.broadcast([tuple(r) for r in items.collect()]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = _tables(key, shared, window)
            for batch in batches:
                rows = []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    hit, found = scan(words, tables)
                    rows.append(verdict(len(words), int(hit.sum()), found))
                yield _batch(batch.column("doc_id"), rows)

        return docs.mapInArrow(run, RESULT)

    # more benchmark than one block may hold: search block by block, then join the hits of a row
    keyed = store(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    numbered = store(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks))), "benchmark")
    partial = None
    for b in range(2 * blocks):
        held = spark.sparkContext.broadcast([tuple(r) for r in numbered.where(F.col("block") == b).select("item_id", "text").collect()])

        def find(batches: Iterator[pa.RecordBatch], held=held, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            tables = _tables(key, held, window)
            for batch in batches:
                rows = []
                for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    hit, found = scan(words_of(text), tables)
                    if found or hit.any():
                        rows.append((row, np.flatnonzero(hit).tolist(), sorted(found)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.list_(pa.string()))], names=["row", "hits", "items"])

        part = keyed.select("row", "text").mapInArrow(find, "row long, hits array<int>, items array<string>")
        partial = part if partial is None else partial.unionByName(part)
    joined = partial.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    both = keyed.join(joined, "row", "left").select("doc_id", "text", F.size(F.coalesce("hits", F.array().cast("array<int>"))).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text").to_pylist(), batch.column("n_hit").to_pylist(), batch.column("items").to_pylist(), strict=True)
            yield _batch(batch.column("doc_id"), [verdict(len(words_of(t)), n, set(f)) for t, n, f in rows])

    return both.mapInArrow(finish, RESULT)


def keep_clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that aren't contaminated, all columns as they are.

    Whether a row is contaminated depends on its text alone, so contaminated (id, text hash) keys,
    which few rows have, are taken out by an anti join.
    """
    key = fresh(df, "key")
    marked = df.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    found = decontaminate(marked, benchmark, id_col=key, text_col=text_col, **options)
    gone = found.where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return marked.join(gone, key, "left_anti").select(*df.columns)
