"""Phrase collocation mining by vertical partitioning of the word suffixes.

Words are numbered per block of texts, and each block is stored once: a stream of its words' numbers, and for
each bucket of words (by their hash) a sorted run of its distinct words with counts. Only words with ``least``
occurrences can stand in a candidate, so every other word ends a phrase like a mark does. A bucket's task sums
its runs; the words that are left get numbers by falling count, and the bucket answers its runs with them.

Each position starts a suffix, cut after ``depth`` words. The suffixes are parted by their first words,
as many as it takes to stay within a memory budget: a prefix ends with its first word that occurs
``budget`` times or less, so no prefix has more suffixes than that, but for one of frequent words only, whose equal
suffixes are one row a block. Prefixes of one word are put together in order until the budget is full,
longer ones by their hash. A block sends each group one sorted run of its distinct suffixes with
counts. A group's task sorts its runs into the leaves of a subtree and reads every phrase's count from leaf
totals. A phrase shorter than its prefix has leaves in several groups; its parts are summed afterwards.

The score of a phrase is that of its worst cut in two: floor(1000 * a * n / (l * r)) in decimals of 38
digits, which hold counts up to 10**12 and 10**13 words. A phrase is dropped if one a word longer has its
count: a longer one's count never exceeds that of the phrases between, so one word tells all.

Defined cases: a null or empty text has no words; a null language is ``und``; null and repeated ids
don't matter, ids aren't read; ties in score and count go by the phrase's bytes; a table without candidates gives
no rows; one very long text is cut into several streams that overlap; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.llm.common import join_apart, scratch, store

#: Marks end a piece; all become one mark, tabs spaces, A-Z lower case.
MARK = b"."
FOLD = bytes(MARK[0] if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
CUT = re.compile(rb"[ .]")
#: Words of a block; bytes of a text that are split at a time; suffixes of a group.
BLOCK_WORDS, SLICE, BUDGET = 700_000, 1 << 20, 500_000
#: Copies of a single word's row in joins, where a frequent word stands in many phrases.
SALTS = 16
BLOCK = "block long, lang string, bucket int, size int, raw int, words binary, n binary, local binary, total long, tail int, stream binary"


def _squeezed(x: np.ndarray) -> bytes:
    """Columns of 32-bit numbers, byte plane by byte plane, compressed."""
    x = np.ascontiguousarray(x, dtype="<u4")
    return pa.compress(x.view(np.uint8).reshape(*x.shape, 4).swapaxes(-1, -2).tobytes(), codec="zstd", asbytes=True)


def _loose(blob: bytes, *shape: int) -> np.ndarray:
    size = 4 * int(np.prod(shape))
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(*shape[:-1], 4, shape[-1]).swapaxes(-1, -2)).view("<u4").reshape(shape)


class _Numbers(dict):
    """Numbers words as they come; the mark is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Stream:
    """The words of one language in a block."""

    def __init__(self, carried: list[bytes] = ()) -> None:
        self.numbers = _Numbers({MARK: 0})
        self.parts, self.size = [], 0
        if carried:
            self.add(carried)

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)

    def rows(self, block: int, lang: str, tail: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """The stream, whose last ``tail`` words are the next block's, and a run of words for each bucket."""
        stream = np.concatenate(self.parts)
        n = np.bincount(stream[: len(stream) - tail], minlength=len(self.numbers))
        yield _batch(BLOCK, block=[block], lang=[lang], bucket=[-1], size=[len(stream)], total=[int(n[1:].sum())], tail=[tail], stream=[_squeezed(stream)])
        words = list(self.numbers)
        order = np.array(sorted(range(1, len(words)), key=words.__getitem__), dtype=np.int64)
        if not len(order):
            return
        own = np.array([crc32(words[i]) % buckets for i in order.tolist()])
        order = order[np.argsort(own, kind="stable")]
        own.sort()
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist()
        cuts = [order[i:j] for i, j in zip(at, [*at[1:], len(order)], strict=True)]
        texts = [b" ".join(map(words.__getitem__, c.tolist())) for c in cuts]
        k = len(cuts)
        yield _batch(
            BLOCK, block=[block] * k, lang=[lang] * k, bucket=own[at], size=[len(c) for c in cuts], raw=[len(t) for t in texts],
            words=[pa.compress(t, codec="zstd", asbytes=True) for t in texts], n=[_squeezed(n[c]) for c in cuts], local=[_squeezed(c) for c in cuts],
        )


def _words_of(raw: int, words: bytes) -> list[bytes]:
    return pa.decompress(words, decompressed_size=raw, codec="zstd", asbytes=True).split(b" ")


def _batch(schema: str, **columns) -> pa.RecordBatch:
    """A batch of ``schema``; columns that aren't given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    rows = len(next(iter(columns.values())))
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * rows), kinds[kind]) for name, kind in named], names=[name for name, _ in named])


def _streams(depth: int, block_words: int, slice_bytes: int, buckets: int):
    """Blocks of (lang, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, {}

        def close(lang: str, tail: int = 0) -> Iterator[pa.RecordBatch]:
            nonlocal block
            yield from held[lang].rows(block, lang, tail, buckets)
            block += 1

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw, at = (text or "").encode().translate(FOLD), 0
                while at < len(raw):
                    cut = CUT.search(raw, at + slice_bytes) if len(raw) - at > slice_bytes else None
                    end = cut.start() if cut else len(raw)
                    words = raw[at:end].replace(MARK, b" . ").split()  # of bytes: spaces only, the rest became marks
                    last = end == len(raw)
                    own = held.setdefault(lang, _Stream())
                    own.add([*words, MARK] if last else words)
                    at = end
                    if own.size >= block_words:
                        # inside a text the last words also start phrases with what follows
                        tail = 0 if last else min(depth - 1, own.size)
                        names = list(own.numbers)
                        carried = [names[i] for i in np.concatenate(own.parts)[own.size - tail :]]
                        yield from close(lang, tail)
                        held[lang] = _Stream(carried)
                if sum(x.size for x in held.values()) > 2 * block_words:
                    most = max(held, key=lambda x: held[x].size)
                    yield from close(most)
                    del held[most]
        for lang in held:
            if held[lang].size:
                yield from close(lang)

    return run


def _sums(least: int):
    """(lang, word, c, bucket): the words of each bucket's runs that occur ``least`` times; rows sorted by bucket and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, Counter()

        def often() -> Iterator[pa.RecordBatch]:
            found = [(w, c) for w, c in counts.items() if c >= least]
            if found:
                yield _batch(WORDS, lang=[key[1]] * len(found), word=[w for w, _ in found], c=[c for _, c in found], bucket=[key[0]] * len(found))

        for batch in batches:
            for bucket, lang, size, raw, words, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "size", "raw", "words", "n")), strict=True):
                if key != (bucket, lang):
                    yield from often()
                    key, counts = (bucket, lang), Counter()
                for word, c in zip(_words_of(raw, words), _loose(n, size).tolist(), strict=True):
                    counts[word] += c
        yield from often()

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of each run's frequent words; rows sorted by bucket, its known words (null block) first."""
    bucket, known = None, {}
    columns = ("bucket", "block", "lang", "size", "raw", "words", "local", "word", "id", "part")
    for batch in batches:
        out = []
        for own, block, lang, size, raw, words, local, word, id_, part in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if own != bucket:
                bucket, known = own, {}
            if block is None:
                known.setdefault(lang, {})[word] = id_, -1 if part is None else part
                continue
            here = known.get(lang, {})
            found = [(i, *here[w]) for i, w in zip(_loose(local, size).tolist(), _words_of(raw, words), strict=True) if w in here]
            if found:
                out.append((block, own, len(found), _squeezed(np.array(found, dtype=np.int64).T.astype("<i4").view("<u4"))))
        if out:
            yield _batch(IDS, **dict(zip(("block", "bucket", "size", "ids"), zip(*out, strict=True), strict=True)))


WORDS, IDS = "lang string, word binary, c long, bucket int", "block long, bucket int, size int, ids binary"


def vocabulary(blocks: DataFrame, least: int, budget: int) -> tuple[DataFrame, dict[str, int]]:
    """(lang, word, bucket, c, n, id, part) of the words that occur ``least`` times, and sums over them.

    ``id`` counts from 1 by falling count, ``n`` is the language's number of words; ``part`` is the group of
    the suffixes that start with the word, null for words with over ``budget`` of them (hot ones).
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = blocks.where("bucket >= 0").select("bucket", "lang", "size", "raw", "words", "n")
    often = store(runs.repartition(parts, "bucket").sortWithinPartitions("bucket", "lang").mapInArrow(_sums(least), WORDS), "often")
    total = store(blocks.where("bucket = -1").groupBy("lang").agg(F.sum("total").alias("n")).join(often.groupBy("lang").agg(F.count("*").alias("rows")), "lang"), "langs")
    # a small table still gives every task some groups
    budget = max(min(budget, (often.agg(F.sum("c").alias("c")).first()["c"] or 0) // (2 * parts)), 1)
    one = often.agg(F.lit(budget).alias("budget"), F.count("*").alias("words"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.when(F.col("c") > budget, 1)).alias("hot"), F.coalesce(F.sum(F.when(F.col("c") > budget, F.col("c"))), F.lit(0)).alias("hot_c")).first().asDict()
    if one["words"] >= 1 << 31:
        raise ValueError("2**31 frequent words or more")
    often = join_apart(often, "lang", total, one["words"], "rows", F.lit(True))
    order = [F.desc("c"), F.asc("lang"), F.asc("word")]
    placed = store(often.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed").withColumn("of", F.shiftright("at", 33))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    offsets = placed.groupBy("of").agg(F.count("*").alias("k"), F.sum("c").alias("c")).select("of", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k_before"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c_before"))
    within = Window.partitionBy("of").orderBy("at")
    placed = placed.withColumn("k", F.row_number().over(within)).withColumn("sum", F.sum("c").over(within) - F.col("c"))
    group = F.floor((F.col("sum") + F.col("c_before") - one["hot_c"]) / F.lit(budget)).cast("int")
    placed = placed.join(F.broadcast(offsets), "of").select("lang", "word", "bucket", "c", "n", (F.col("k") + F.col("k_before")).alias("id"), F.when(F.col("c") <= budget, group).alias("part"))
    return store(placed, "vocabulary"), one


RUN = "part int, size int, suffixes binary, n binary"


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _changes(columns: np.ndarray) -> np.ndarray:
    """Per column: where it or one before it differs from the row above."""
    out = np.ones(columns.shape, dtype=bool)
    out[:, 1:] = columns[:, 1:] != columns[:, :-1]
    return np.logical_or.accumulate(out, axis=0)


def _runs(depth: int, hot: int, plain_parts: int, hot_parts: int):
    """Each block's distinct suffixes, sorted, a run a group: rows of a block's stream (bucket -1), then of its words' numbers."""

    def packed(tail: int, stream: np.ndarray, local: np.ndarray, ids: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids)
        ids, parts = ids[order], parts[order]
        codes = np.zeros(max(int(stream.max()), int(local.max())) + 1, dtype=np.int64)
        codes[local[order]] = np.arange(1, len(ids) + 1)  # 0: a mark or a rare word
        own = np.concatenate([codes[stream], np.zeros(depth, dtype=np.int64)])
        starts = np.flatnonzero((own[: len(stream) - tail] > 0) & (own[1 : len(stream) - tail + 1] > 0))
        if not len(starts):
            return _batch(RUN, part=[], size=[], suffixes=[], n=[])
        columns = np.empty((depth, len(starts)), dtype=np.int64)
        columns[0] = own[starts]
        for j in range(1, depth):
            columns[j] = np.where(columns[j - 1] > 0, own[starts + j], 0)
        # at most 2**21 words in a block, so three fit in a key
        keys = [sum(c << (21 * (2 - i)) for i, c in enumerate(columns[lo : lo + 3])) for lo in range(0, depth, 3)]
        order = np.lexsort(keys[::-1])
        keys = np.array([k[order] for k in keys])
        first = np.flatnonzero(_changes(keys)[-1])
        n = np.diff(np.append(first, len(starts)))
        columns = columns[:, order[first]]
        ids, parts = np.concatenate([[0], ids]).astype(np.uint64), np.concatenate([[-1], parts])
        words = ids[columns]
        longer, h = words[0] <= hot, _mixed(np.full(len(n), 7, dtype=np.uint64), words[0])
        for j in range(1, depth):  # the prefix goes on to its first word that isn't hot
            h = np.where(longer, _mixed(h, words[j]), h)
            longer = longer & (words[j] > 0) & (words[j] <= hot)
        part = np.where(words[0] <= hot, plain_parts + (h % np.uint64(max(hot_parts, 1))).astype(np.int64), parts[columns[0]])
        order = np.argsort(part, kind="stable")
        part, words, n = part[order], words[:, order].astype("<u4"), n[order].astype("<u4")
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
        cuts = list(zip(at, [*at[1:], len(part)], strict=True))
        return _batch(RUN, part=part[at], size=[j - i for i, j in cuts], suffixes=[_squeezed(words[:, i:j]) for i, j in cuts], n=[_squeezed(n[i:j]) for i, j in cuts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).to_pylist()
            if rows[0]["bucket"] == -1 and len(rows) > 1:  # else no word of the block is frequent
                stream = _loose(rows[0]["stream"], rows[0]["size"])
                local, ids, parts = np.concatenate([_loose(r["ids"], 3, r["size"]).view("<i4") for r in rows[1:]], axis=1).astype(np.int64)
                yield packed(rows[0]["tail"], stream, local, ids, parts)

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            at = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])).tolist() if len(blocks) else []
            for i, j in zip(at, [*at[1:], len(blocks)], strict=True):
                if held and held[0].column("block")[0].as_py() != blocks[i]:
                    yield from close()
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield from close()

    return run


def subtree_counts(words: np.ndarray, n: np.ndarray, least: int, hot: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, counts) by length, from suffixes (a column a word, 0 after their end) and their counts.

    Phrases below ``least`` are left out, but for those that may have leaves elsewhere: of hot words only, and
    shorter than the depth.
    """
    depth = len(words)
    wide = [words[lo].astype(np.uint64) << np.uint64(32) | (words[lo + 1] if lo + 1 < depth else np.uint64(0)) for lo in range(0, depth, 2)]
    order = np.lexsort(wide[::-1])
    words, n = words[:, order], n[order]
    changes = _changes(words)
    for m in range(2, depth + 1):
        at = np.flatnonzero(changes[m - 1])
        at_words = words[:m, at]
        sums = np.add.reduceat(n, at)
        keep = at_words[-1] > 0
        if m < depth:
            keep &= (sums >= least) | (at_words <= hot).all(axis=0)
        else:
            keep &= sums >= least
        yield at_words[:, keep].T, sums[keep]


def _trees(depth: int, least: int, hot: int):
    """(phrase, a) of each group's runs."""

    def counted(runs: list[tuple]) -> Iterator[pa.RecordBatch]:
        words = np.concatenate([_loose(x[2], depth, x[1]) for x in runs], axis=1)
        n = np.concatenate([_loose(x[3], x[1]) for x in runs]).astype(np.int64)
        for phrases, sums in subtree_counts(words, n, least, hot):
            for lo in range(0, len(sums), 100_000):
                own = phrases[lo : lo + 100_000].astype(np.int64)
                ends = np.arange(len(own) + 1, dtype=np.int32) * own.shape[1]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(own.ravel())), pa.array(sums[lo : lo + 100_000])], names=["phrase", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "suffixes", "n")), strict=True):
                if held and held[0][0] != row[0]:
                    yield from counted(held)
                    held = []
                held.append(row)
        if held:
            yield from counted(held)

    return run


def phrase_counts(df: DataFrame, least: int = 100, depth: int = 5, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET, block_words: int = BLOCK_WORDS, slice_bytes: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(phrase, a) of all phrases of 2 to ``depth`` words with ``least`` occurrences, as numbers of words, and
    the words (id, lang, word, c, n). Both are stored."""
    if depth < 2 or block_words >= 1 << 21:
        raise ValueError("two words at least; fewer than 2**21 words a block")
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    with scratch(spark):
        blocks = store(texts.mapInArrow(_streams(depth, block_words, slice_bytes, parts), BLOCK), "blocks")
        with scratch(spark):
            known, one = vocabulary(blocks, least, budget)
            known = store(known, "vocabulary", keep=True)
        plain, hot_parts = (one["c"] - one["hot_c"]) // one["budget"] + 1, 2 * one["hot_c"] // one["budget"] + 1
        asked = blocks.where("bucket >= 0").select("bucket", "block", "lang", "size", "raw", "words", "local")
        asked = known.select("bucket", "lang", "word", "id", "part").unionByName(asked, allowMissingColumns=True)
        ids = asked.repartition(parts, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("block")).mapInArrow(_numbered, IDS)
        both = blocks.where("bucket = -1").select("block", "bucket", "size", "tail", "stream").unionByName(ids, allowMissingColumns=True)
        both = both.repartition(parts, "block").sortWithinPartitions("block", "bucket")
        runs = both.mapInArrow(_runs(depth, one["hot"], plain, hot_parts), RUN)
        found = runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_trees(depth, least, one["hot"]), "phrase array<long>, a long")
        phrases = store(found.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases", keep=True)
        return phrases, store(known, "words", keep=True)


def _salt(phrase: Column, key: Column) -> Column:
    return F.when(F.size(key) == 1, F.pmod(F.xxhash64(phrase), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))


def mine_phrases(df: DataFrame, top: int = 2000, least: int = 100, depth: int = 5, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET, block_words: int = BLOCK_WORDS, slice_bytes: int = SLICE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases."""
    phrases, words = phrase_counts(df, least, depth, lang_col, text_col, budget, block_words, slice_bytes)
    single = words.select(F.array("id").alias("key"), F.col("c").alias("f"), "lang", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    counts = single.unionByName(phrases.select(F.col("phrase").alias("key"), F.col("a").alias("f"), F.lit(0).alias("salt")), allowMissingColumns=True)
    size = F.size("phrase")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("left", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("right", F.slice("phrase", F.col("k") + 1, size - F.col("k")))
    for side, name in (("left", "l"), ("right", "r")):
        own = counts.select(F.col("key").alias(side), F.col("salt"), F.col("f").alias(name), *([F.col("lang"), F.col("n")] if side == "left" else []))
        cuts = cuts.withColumn("salt", _salt(F.col("phrase"), F.col(side))).join(own, [side, "salt"]).drop("salt")
    # the language and its words come with the cut after one word; at most depth - 1 cuts a phrase are gathered
    scored = cuts.groupBy("phrase").agg(F.first("a").alias("a"), F.max("lang").alias("lang"), F.max("n").alias("n"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    wide = lambda c: c.cast("decimal(19,0)")
    scored = scored.select("phrase", "a", "lang", "n", "cuts", (wide(F.col("a")) * wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)")).alias("top"))
    scored = scored.select("phrase", "a", "lang", "n", F.expr("array_min(transform(cuts, c -> named_struct('score', top div (cast(c.l as decimal(19,0)) * cast(c.r as decimal(19,0))), 'k', c.k, 'l', c.l, 'r', c.r)))").alias("cut"))

    long = phrases.where(size > 2)
    inner = long.select(F.explode(F.array(F.slice("phrase", F.lit(1), size - 1), F.slice("phrase", F.lit(2), size - 1))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, "phrase", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    # all that tie with the last that fits get their words, then ties go by these
    by_count = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = store(kept.withColumn("rank", F.rank().over(by_count)).where(F.col("rank") <= top).drop("rank"), "best")
    spelt = best.select("phrase", F.posexplode("phrase").alias("at", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("words"))
    best = best.join(spelt, "phrase").select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "l", "r", "n", "score")
    by_phrase = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(by_phrase)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
