"""Language-model scoring: prediction by partial matching over bytes, and a unigram base.

The model is a context trie of order 5 over all bytes, gathered from the training rows; the end of a
text, also before its first byte, is the byte 255, which UTF-8 never has. A symbol's probability is
counted in the longest context; if it didn't follow there, an escape of weight (distinct symbols) is
paid and the next shorter context is asked, without the symbols that were already ruled out
(exclusion); below order 0 the rest is uniform.

The trie stays distributed and grows with the corpus. Every block of documents gives its distinct
grams (five symbols and the next) with their training counts, packed by a bucket of the last three
context symbols. A shuffle meets the blocks of a bucket, which then holds whole contexts: there each
gram gets its log probability, and another shuffle brings these back to the block's texts. Only the
counts of orders 0 to 2, which have 256**3 grams at most, are shared.

The base is a unigram model of words with additive smoothing. Words aren't bounded, so their counts
stay distributed: every block gives its distinct words with their training counts, an aggregation
that combines before its shuffle sums them, and the sums go back to the blocks that hold the word, where
they meet the block's texts. A frequent word has one short row a block.

Defined cases: a null or empty text is its end token alone; null ids are training rows
and null in ``held_out``'s hash, so held_out is false; null and repeated ids give a row each; without
training rows all counts are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import numbered, remainder, scratch, store

END, ORDER = 255, 5
#: Bytes of text whose grams are gathered at a time.
TRIE_BYTES = 6 << 20
#: Documents that one block holds at most.
BLOCK_DOCS = 60_000


def _fold(text: str | None) -> bytes:
    return (text or "").encode().lower()  # of bytes: A-Z only


class _Cut:
    """Deals rows out to blocks, by their first row; passes over the same rows cut alike."""

    def __init__(self, most: int) -> None:
        self.most, self.first, self.docs, self.size = most, None, 0, 0

    def place(self, row: int, size: int) -> int:
        if self.first is None or self.docs == BLOCK_DOCS or self.size > self.most or row != self.first + self.docs:
            self.first, self.docs, self.size = row, 0, 0
        self.docs += 1
        self.size += size
        return self.first


def _grams(raws: list[bytes]) -> np.ndarray:
    """Sorted: the five symbols before each symbol, nearest first, the symbol, and the number of its text (16 bits)."""
    pad = bytes([END]) * ORDER
    flat = np.frombuffer(pad + pad.join(raws) + pad, dtype=np.uint8)
    lengths = np.array([len(x) + 1 for x in raws])
    slots = np.repeat(np.arange(len(raws), dtype=np.uint16), lengths)
    # of the padding after a text only the first symbol, its end, is predicted
    at = np.repeat(np.arange(len(raws), dtype=np.int64) * (ORDER - 1), lengths)
    at += np.arange(len(slots))
    out = np.zeros(len(slots), dtype=np.uint64)
    for back in (*range(1, ORDER + 1), 0):
        out <<= np.uint64(8)
        out |= flat[ORDER - back :][at]
    out <<= np.uint64(16)
    out |= slots
    out.sort()
    return out


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their n."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], _starts(keys[order])
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _shorter(keys: np.ndarray) -> np.ndarray:
    """Grams (context, symbol) without the farthest symbol of the context."""
    return (keys >> np.uint64(16)) << np.uint64(8) | keys & np.uint64(255)


def _find(table: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values at each key, 0 where the table lacks it."""
    if not len(table):
        return [np.zeros(len(keys), dtype=np.int64) for _ in values]
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    has = table[at] == keys
    return [np.where(has, v[at], 0) for v in values]


def gram_logs(grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 P(symbol | context) of distinct sorted grams, with escapes and exclusion.

    ``counts``: in training, 0 allowed; of each context of three symbols all grams or none must be
    here. ``low``: grams of order 2 and their counts in all of training.

    What follows a context also follows its shorter ones, so the symbols ruled out at a length are
    those of the context one longer, and sums over them are kept by that context.
    """
    levels = {ORDER: (grams[counts > 0], counts[counts > 0]), 2: low}
    for j in (*range(ORDER - 1, 2, -1), 1, 0):
        levels[j] = _summed(_shorter(levels[j + 1][0]), levels[j + 1][1])
    contexts = {}
    for j, (keys, n) in levels.items():
        at = _starts(keys >> np.uint64(8))
        sums = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]  # noqa: B023, E731
        below = _find(levels[j - 1][0], _shorter(keys), levels[j - 1][1])[0] if j else n
        contexts[j] = (keys[at] >> np.uint64(8), sums(n), sums(np.ones(len(n), dtype=np.int64)), sums(below))
    weight, p, open_ = np.ones(len(grams)), np.zeros(len(grams)), np.ones(len(grams), dtype=bool)
    out_kinds = out_total = np.zeros(len(grams), dtype=np.int64)
    keys = grams
    for j in range(ORDER, -1, -1):
        total, kinds, below = _find(contexts[j][0], keys >> np.uint64(8), *contexts[j][1:])
        n = _find(levels[j][0], keys, levels[j][1])[0]
        total, free_kinds, left = total - out_total, kinds - out_kinds, kinds < 256
        whole = np.maximum(np.where(left, total + free_kinds, total), 1)
        here = open_ & (n > 0)
        p = np.where(here, weight * n / whole, p)
        weight = np.where(total > 0, weight * np.where(left, free_kinds / whole, 0.0), weight)
        open_ &= ~here
        out_kinds, out_total, keys = kinds, below, _shorter(keys)
    p = np.where(open_, weight / np.maximum(256 - out_kinds, 1), p)
    return np.log10(np.maximum(p, 1e-300)).astype("<f4")


def _buckets(grams: np.ndarray, buckets: int) -> np.ndarray:
    """By the three context symbols next to the gram's last."""
    return (((grams >> np.uint64(24)) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def fit_low(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams of order 2 of ``train`` (text) and their counts; 256**3 at most."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, raws, size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            own = _grams(raws) >> np.uint64(16)
            own = own >> np.uint64(32) << np.uint64(8) | own & np.uint64(255)
            own.sort()
            at = _starts(own)
            return _summed(np.concatenate([codes, own[at]]), np.concatenate([n, np.diff(np.append(at, len(own)))]))

        for batch in batches:
            for text in batch.column("text").to_pylist():
                raws.append(_fold(text))
                size += len(raws[-1])
                if size > TRIE_BYTES or len(raws) == BLOCK_DOCS:
                    codes, n = fold()
                    raws, size = [], 0
        if raws:
            codes, n = fold()
        for lo in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[lo : lo + 100_000].astype(np.int64)), pa.array(n[lo : lo + 100_000])], names=["code", "n"])

    found = train.mapInArrow(seen, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return _summed(np.asarray(found.column("code").to_numpy()).astype(np.uint64), np.asarray(found.column("n").to_numpy()).astype(np.int64))


def _squeezed(x: np.ndarray) -> bytes:
    """Items of one width, byte plane by byte plane, compressed: equal high bytes cost nearly nothing."""
    return pa.compress(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _loose(blob: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(blob, decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T.copy().view(kind).ravel()


def trie_scores(docs: DataFrame, counts: DataFrame, block_bytes: int = TRIE_BYTES) -> DataFrame:
    """(row, doc_id, n_tokens, score, n_bytes, logs, known) of ``docs`` (row, doc_id, text, train).

    ``counts`` (block, word, c): training counts of each block's words; ``logs`` sums log10(c + 0.1) over
    a text's words and ``known`` counts those with c > 0.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    shared = spark.sparkContext.broadcast(fit_low(docs.where("train").select("text")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, block, raws, train = _Cut(block_bytes), None, [], []

        def packed() -> Iterator[pa.RecordBatch]:
            keys = _grams(raws)
            used = np.array(train, dtype=np.uint32)[keys.astype(np.uint16)]  # the low 16 bits: the text
            keys >>= np.uint64(16)
            at = _starts(keys)
            grams, n = keys[at], np.add.reduceat(used, at)
            own = _buckets(grams, buckets)
            order = np.argsort(own, kind="stable")
            grams, n, own = grams[order].astype("<u8"), n[order].astype("<u4"), own[order]
            first = _starts(own)
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True))
            # a bucket's grams are in order, so steps from one to the next are small
            steps = [_squeezed(np.diff(grams[i:j], prepend=np.uint64(0)).astype("<u8")) for i, j in cuts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[first].astype(np.int32)), pa.array(np.full(len(first), block, dtype=np.int64)), pa.array([j - i for i, j in cuts], pa.int32()), pa.array(steps, pa.binary()), pa.array([_squeezed(n[i:j]) for i, j in cuts], pa.binary())],
                names=["bucket", "block", "size", "grams", "n"],
            )

        for batch in batches:
            for row, text, own in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True):
                raw = _fold(text)
                to = cut.place(row, len(raw))
                if raws and to != block:
                    yield from packed()
                    raws, train = [], []
                block = to
                raws.append(raw)
                train.append(own)
        if raws:
            yield from packed()

    def answer(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
        each = [np.cumsum(_loose(x[3], "<u8", x[2]), dtype=np.uint64) for x in rows]
        grams, n = _summed(np.concatenate(each), np.concatenate([_loose(x[4], "<u4", x[2]) for x in rows]).astype(np.int64))
        logs = gram_logs(grams, n, shared.value)
        found = [len(x).to_bytes(4, "little") + _squeezed(logs[np.searchsorted(grams, x)]) for x in each]
        return pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows], pa.int64()), pa.array([x[0] for x in rows], pa.int32()), pa.array(found, pa.binary())], names=["block", "bucket", "logs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for own in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "size", "grams", "n")), strict=True):
                if rows and own[0] != rows[0][0]:
                    yield answer(rows)
                    rows = []
                rows.append(own)
        if rows:
            yield answer(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _Cut(block_bytes)
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            blocks = [cut.place(row, size or 0) for row, size in zip(batch.column("row").to_pylist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(batch.column(c) for c in ("row", "doc_id", "text"))], names=["block", "row", "doc_id", "text"])

    def score(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        bucket = whole.column("bucket").to_numpy()
        texts, words, logs = (whole.filter(pa.array(x)) for x in (bucket == TEXT, bucket == WORD, bucket >= 0))
        raws = [_fold(t) for t in texts.column("text").to_pylist()]
        keys = _grams(raws)
        slots = keys.astype(np.uint16)  # the low 16 bits: the text
        keys >>= np.uint64(16)
        at = _starts(keys)
        found = np.empty(len(at), dtype="<f4")
        found[np.argsort(_buckets(keys[at], buckets), kind="stable")] = np.concatenate([_loose(x[4:], "<f4", int.from_bytes(x[:4], "little")) for x in logs.column("logs").to_pylist()])
        sums = np.bincount(slots, weights=np.repeat(found, np.diff(np.append(at, len(keys)))), minlength=len(raws))
        # words without a training count aren't listed
        worth = dict(zip(words.column("word").to_pylist(), np.log10(words.column("c").to_numpy() + 0.1).tolist(), strict=True))
        base, known, tokens = [], [], []
        for raw in raws:
            own = raw.split()  # of bytes: ASCII white space only
            each = np.fromiter(map(worth.get, own, repeat(-1.0)), np.float64, len(own))
            base.append(float(each.sum()))
            known.append(int((each > 0).sum()))
            tokens.append(len(own) + 1)
        return pa.RecordBatch.from_arrays(
            [texts.column("row").combine_chunks(), texts.column("doc_id").combine_chunks(), pa.array(tokens, pa.int64()), pa.array(sums), pa.array([len(x) for x in raws], pa.int64()), pa.array(base, pa.float64()), pa.array(known, pa.int64())],
            names=["row", "doc_id", "n_tokens", "score", "n_bytes", "logs", "known"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            first = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])).tolist() if len(blocks) else []
            for i, j in zip(first, [*first[1:], len(blocks)], strict=True):
                if held and blocks[i] != block:
                    yield score(held)
                    held = []
                block = blocks[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield score(held)

    grams = docs.select("row", "text", "train").mapInArrow(gather, "bucket int, block long, size int, grams binary, n binary")
    logs = grams.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "block long, bucket int, logs binary")
    texts = docs.select("row", "doc_id", "text").mapInArrow(place, "block long, row long, doc_id long, text string").withColumn("bucket", F.lit(TEXT))
    words = counts.select("block", F.lit(WORD).alias("bucket"), "word", "c")
    # a block's texts come first, then its words, then the logs of its grams by bucket
    both = texts.unionByName(words, allowMissingColumns=True).unionByName(logs, allowMissingColumns=True)
    both = both.repartition(parts, "block").sortWithinPartitions("block", "bucket", "row")
    return both.mapInArrow(run, "row long, doc_id long, n_tokens long, score double, n_bytes long, logs double, known long")


#: Rows of a block that aren't logs of a bucket's grams.
TEXT, WORD = -2, -1


def _block_words(block_bytes: int):
    """(block, word, n): the distinct words of each block and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, block, used, seen = _Cut(block_bytes), None, Counter(), set()

        def listed() -> Iterator[pa.RecordBatch]:
            words = sorted(seen)
            for lo in range(0, len(words), 50_000):
                own = words[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block, dtype=np.int64)), pa.array(own, pa.binary()), pa.array([used[w] for w in own], pa.int64())], names=["block", "word", "n"])

        for batch in batches:
            for row, text, train in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True):
                raw = _fold(text)
                to = cut.place(row, len(raw))
                if to != block:
                    yield from listed()
                    used, seen = Counter(), set()
                block = to
                words = raw.split()
                seen.update(words)
                if train:
                    used.update(words)
        yield from listed()

    return run


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 10, block_bytes: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) a document.

    ``score`` is the trie's log10 probability of the whole lower-cased text and its end; rows whose
    crc32 remainder by ``mod`` is 0 are held out of all counts.
    """
    spark = df.sparkSession
    held = F.coalesce(remainder("doc_id", mod) == 0, F.lit(False))
    docs = numbered(df, id_col, text_col).withColumn("train", ~held)

    with scratch(spark):  # the word tables are gone before the trie is gathered
        words = store(docs.select("row", "text", "train").mapInArrow(_block_words(block_bytes), "block long, word binary, n long"), "words")
        sums = store(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "sums")
        train_docs = docs.where("train").count()
        seen = sums.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        counts = store(words.select("block", "word").join(sums, "word"), "counts", keep=True)
    n, v = (seen["n"] or 0) + train_docs, seen["v"] + (train_docs > 0)
    denominator = float(np.log10(n + 0.1 * (v + 1)))
    end_log, end_known = float(np.log10(train_docs + 0.1)), int(train_docs > 0)

    return trie_scores(docs.select("row", "doc_id", "text", "train"), counts, block_bytes).select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.lit(end_known)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(end_log) - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        "score",
        "n_bytes",
    )
