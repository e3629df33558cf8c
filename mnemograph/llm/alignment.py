"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, and how often.

A text is cut before each space or newline that follows a character of another kind, and mostly before a mark
after letters. No token of either tokenizer goes across such a cut, so a part's tokens, groups and links are
made once per worker and kept in a cache of two generations that is bounded by bytes. Links of a group: a step along both token lists meets every pair that overlaps.

Pairs are counted over all documents by external runs. A block of texts holds its pair-document records sorted
by the B side, and gives each radix of B ids one zstd run of its distinct pairs with counts. A task
merges the runs of a radix with a heap, which counts each pair; where there are more runs than ``fan``,
slices of them are merged first and then the slices. Side-major order leaves the pairs of a B id side by side, so its
maximum is read in the same pass. The radix's table then answers every run with its pairs' counts and
whether they are the highest, and the block streams these back into its documents. What a pair that stands in every
document sends is one record a block; the table of a radix is bounded by the two vocabularies.

Defined cases: a null or empty text, or one whose joined tokens of A or B differ from space + text (it holds U+2581),
has no tokens: zeros and an empty string; null and repeated ids give a row each; a very long text is
worked on in slices and may lie in several blocks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import scratch, store, take_over, two
from mnemograph.llm.lm_scoring import _loose, _squeezed
from mnemograph.llm.token_counts import byte_symbols
from mnemograph.llm.tokens import ODD_SPACE, WIDE_SPACE

#: Parts where every white space is one space or newline between other characters: words, cut before a mark that
#: follows their letters; parts of any other text.
PLAIN = re.compile("[ \n]?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[.,;:!?])|[^ \n]+)")
MARKS = ".,;:!?"
MIXED = re.compile("(?<=[^\\s\x1c-\x1f\x85᠎﻿])(?=[ \n])")
#: Links and documents of a block; characters of a text worked on at a time; radixes of B ids; runs merged at a time.
BLOCK_LINKS, BLOCK_DOCS, SLICE, RADIXES, FAN = 1_500_000, 60_000, 500_000, 64, 2000

DOCS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RUNS = "block long, radix int, size int, codes binary, n binary"
RECORDS = "block long, rows binary, docs binary, slots binary, times binary, n_docs int, n_codes int, n_records int"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(schema: str, **columns) -> pa.RecordBatch:
    """A batch of ``schema``; columns that aren't given are null."""
    rows = len(next(iter(columns.values())))
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * rows), _KINDS[kind]) for name, kind in named], names=[name for name, _ in named])


def align(a: list[int], b: list[int], a_size: list[int], b_size: list[int], names: list[str]) -> tuple[str, int, list[int]]:
    """Groups as text, their number, and a code for each link, of tokens that cover the same bytes; ``names`` are ids as text."""
    if len(a) == 1 or len(b) == 1:  # one group, and each token overlaps the single one
        return f"{','.join([names[x] for x in a])}|{','.join([names[y] for y in b])}", 1, [y << 16 | x for y in b for x in a]
    groups, links = [], []
    i = j = first_i = first_j = 0
    end_a, end_b = a_size[a[0]], b_size[b[0]]
    while True:
        links.append(b[j] << 16 | a[i])
        if end_a == end_b:
            i, j = i + 1, j + 1
            groups.append(f"{','.join([names[x] for x in a[first_i:i]])}|{','.join([names[y] for y in b[first_j:j]])}")
            if i == len(a):
                return ";".join(groups), len(groups), links
            first_i, first_j = i, j
            end_a, end_b = end_a + a_size[a[i]], end_b + b_size[b[j]]
        elif end_a < end_b:
            i += 1
            end_a += a_size[a[i]]
        else:
            j += 1
            end_b += b_size[b[j]]


class Aligner:
    """Numbers the parts of texts and knows their tokens, groups and links.

    ``forget`` makes the cache the older generation when it holds half of ``most_bytes``; numbers hold until
    then, and what is met again is taken over from the older one.
    """

    def __init__(self, a_name: str, b_name: str, most_bytes: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a_name, b_name = (x if os.path.isabs(x) else public_tokenizers.path(x) for x in (a_name, b_name))
        self.a, self.b, self.most = Tokenizer.from_file(a_name), sentencepiece.SentencePieceProcessor(model_file=b_name), most_bytes
        self.a.encode_special_tokens = True
        if self.a.get_vocab_size() > 1 << 16 or self.b.get_piece_size() > 1 << 15:
            raise ValueError("a pair of ids must fit in 31 bits")
        back = {c: i for i, c in enumerate(byte_symbols())}
        self.a_bytes = [bytes(back[c] for c in self.a.id_to_token(i) or "" if c in back) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(pieces)))]
        crossing = any("\n" in p or "▁" in p.lstrip("▁") or any(x.isalpha() and y in MARKS for x, y in zip(p, p[1:])) for p in pieces)
        if crossing:
            raise ValueError("a piece of B goes across a cut")
        self.clear()
        self.older = self.numbers, self.groups, self.links, self.totals, self.bad

    def clear(self) -> None:
        self.numbers, self.groups, self.links, self.bad, self.held = {}, [], [], set(), 0
        self.totals = array("q")  # four a part: A tokens, B tokens, groups, links

    def forget(self) -> None:
        if self.held > self.most // 2:
            self.older = self.numbers, self.groups, self.links, self.totals, self.bad
            self.clear()

    def _keep(self, part: str, text: str, links: bytes, sums: tuple[int, int, int, int] | array, bad: bool) -> None:
        if bad:
            self.bad.add(len(self.groups))
        self.numbers[part] = len(self.groups)
        self.groups.append(text)
        self.links.append(links)
        self.totals.extend(sums)
        self.held += 330 + len(part) + len(text) + len(links)

    def _learn(self, parts: list[str]) -> None:
        coded_a = [x.ids for x in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        # B puts a space before its input: a part's own, or one that is taken off again with a newline after it
        spaced = [p[0] == " " for p in parts]
        coded_b = self.b.encode([p[1:] if x else "\n" + p for p, x in zip(parts, spaced, strict=True)], num_threads=1)
        for part, space, a, b in zip(parts, spaced, coded_a, coded_b, strict=True):
            raw = part.encode()
            if part == " ":
                b = [self.b.piece_to_id("▁")]
            elif not space:
                b = b[2:]
            if b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)):
                text, n, links = align(a, b, self.a_size, self.b_size, self.names)
                self._keep(part, text, pack(f"<{len(links)}I", *links), (len(a), len(b), n, len(links)), False)
            else:
                self._keep(part, "", b"", (0, 0, 0, 0), True)

    def parts(self, text: str) -> list[str]:
        """The parts of a text that starts with its space or newline."""
        plain = text[-1] not in " \n" and not any(x in text for x in ODD_SPACE) and not WIDE_SPACE.search(text)
        return PLAIN.findall(text) if plain else MIXED.split(text)

    def learn(self, parts: Iterable[str]) -> None:
        """Know these parts; the tokenizers are called for many at a time."""
        new, (numbers, groups, links, totals, bad) = [], self.older
        for part in {*parts}.difference(self.numbers):
            i = numbers.get(part)
            if i is None:
                new.append(part)
            else:
                self._keep(part, groups[i], links[i], totals[4 * i : 4 * i + 4], i in bad)
        for lo in range(0, len(new), 2000):
            self._learn(new[lo : lo + 2000])

    def of(self, parts: list[str]) -> list[int]:
        """Numbers of known parts."""
        return list(map(self.numbers.__getitem__, parts))

    def sums(self, numbers: np.ndarray) -> list[int]:
        return np.frombuffer(self.totals, dtype=np.int64).reshape(-1, 4)[numbers].sum(axis=0).tolist()


def slices(text: str, most: int) -> Iterator[str]:
    """Space + text in slices that end where parts do."""
    text, at = " " + text, 0
    while at < len(text):
        cut = MIXED.search(text, at + most) if len(text) - at > most else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class _Block:
    """The parts of some documents, or of slices of them."""

    def __init__(self) -> None:
        self.parts, self.rows, self.n_links, self.own = [], [], 0, {}

    def add(self, row: int, numbers: np.ndarray, n_links: int) -> None:
        self.parts.append(numbers)
        self.rows.append(row)
        self.n_links += n_links

    def records(self, aligner: Aligner) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(radix and code of each distinct pair, in order, its first record, the slots of records, times in it)."""
        slot = np.repeat(np.arange(len(self.parts), dtype=np.uint64), [len(x) for x in self.parts])
        keys = np.concatenate(self.parts).astype(np.uint64) << np.uint64(16) | slot
        keys, times = np.unique(keys, return_counts=True)
        part, slot = keys >> np.uint64(16), keys & np.uint64(65535)
        fresh = np.concatenate([[True], part[1:] != part[:-1]])
        used, at = part[fresh], np.cumsum(fresh) - 1
        links = [aligner.links[i] for i in used.tolist()]
        size = np.array([len(x) // 4 for x in links], dtype=np.int64)
        codes, first = np.frombuffer(b"".join(links), dtype="<u4").astype(np.uint64), np.concatenate([[0], np.cumsum(size)])[:-1]
        # every part's links once for each document that has it
        n = size[at]
        end = np.cumsum(n)
        codes = codes[np.repeat(first[at] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        codes = (codes >> np.uint64(16)) % np.uint64(RADIXES) << np.uint64(31) | codes
        keys, times = codes << np.uint64(16) | np.repeat(slot, n), np.repeat(times, n)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, times = keys[fresh], np.add.reduceat(times, fresh)
        codes = keys >> np.uint64(16)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], first, keys & np.uint64(65535), times


_made: dict[tuple[str, str], Aligner] = {}


def _blocks(a_name: str, b_name: str, cache_bytes: int, block_links: int, slice_chars: int):
    """Rows of three kinds in one table: documents, runs of a block's pairs, and its records."""
    schema = f"{DOCS}, {RUNS}, {RECORDS.removeprefix('block long, ')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        take_over("alignment", _made.clear)
        if (a_name, b_name) not in _made:
            _made[a_name, b_name] = Aligner(a_name, b_name, cache_bytes)
        aligner = _made[a_name, b_name]
        aligner.most = cache_bytes
        base = TaskContext.get().partitionId() << 40
        row, number, block, docs = base, base, _Block(), []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, block, docs
            if docs:
                yield _batch(schema, **dict(zip([x.split()[0] for x in DOCS.split(", ")], zip(*docs, strict=True), strict=True)))
            if block.parts:
                codes, first, slots, times = block.records(aligner)
                radix = (codes >> np.uint64(31)).astype(np.int64)
                bare, n = (codes & np.uint64((1 << 31) - 1)).astype("<u4"), np.add.reduceat(times, first)
                at = np.flatnonzero(np.concatenate([[True], radix[1:] != radix[:-1]])).tolist()
                cuts = list(zip(at, [*at[1:], len(radix)], strict=True))
                yield _batch(
                    schema, block=[number] * len(cuts), radix=radix[at], size=[j - i for i, j in cuts],
                    codes=[_squeezed(np.diff(bare[i:j], prepend=np.uint32(0)).astype("<u4")) for i, j in cuts], n=[_squeezed(n[i:j].astype("<u4")) for i, j in cuts],
                )
                per_code = np.diff(np.append(first, len(slots)))
                yield _batch(
                    schema, block=[number], rows=[_squeezed(np.array(block.rows, dtype="<u8"))], docs=[_squeezed(per_code.astype("<u4"))], slots=[_squeezed(slots.astype("<u2"))],
                    times=[_squeezed(times.astype("<u4"))], n_docs=[len(block.rows)], n_codes=[len(first)], n_records=[len(slots)],
                )
            number, block, docs = number + 1, _Block(), []
            aligner.forget()

        def place(row: int, doc_id: int | None, text: str | None, parts: list[list[str]] | None) -> Iterator[pa.RecordBatch]:
            """Put a document into the block; ``parts`` of its slices, or those of a long text one slice at a time."""
            sums, digest, good = [0, 0, 0, 0], "", bool(text)
            long = parts is None
            if long:  # known before the first of its records is written
                for piece in slices(text, slice_chars):
                    own = aligner.parts(piece)
                    aligner.learn(own)
                    good = good and aligner.bad.isdisjoint(aligner.of(own))
            numbers = [] if long else [aligner.of(p) for p in parts]
            if good and aligner.bad and not all(aligner.bad.isdisjoint(x) for x in numbers):
                good = False
            if good:
                sha, between = hashlib.sha256(), b""
                for own in (aligner.parts(x) for x in slices(text, slice_chars)) if long else numbers:
                    if long:
                        aligner.learn(own)
                        own = aligner.of(own)
                    sha.update(between + ";".join(map(aligner.groups.__getitem__, own)).encode())
                    between = b";"
                    own = np.array(own, dtype=np.int32)
                    more = aligner.sums(own)
                    sums = [x + y for x, y in zip(sums, more, strict=True)]
                    block.add(row, own, more[3])
                    if block.n_links > block_links and long:
                        yield from close()
                digest = sha.hexdigest()
            docs.append((row, doc_id, *sums, digest))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, size
            aligner.learn(part for _, _, _, parts in waiting for own in parts or () for part in own)
            for own in waiting:
                yield from place(*own)
            waiting, size = [], 0
            if block.n_links > block_links or len(docs) >= BLOCK_DOCS:
                yield from close()

        waiting, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                long = bool(text) and len(text) >= slice_chars
                if long:
                    yield from flush()
                waiting.append((row, doc_id, text, None if long else [aligner.parts(" " + text)] if text else []))
                size += len(text or "")
                row += 1
                if long or size >= slice_chars or len(docs) + len(waiting) >= BLOCK_DOCS:
                    yield from flush()
        yield from flush()
        if docs or block.parts:
            yield from close()

    return run, schema


def merge_counts(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of sorted runs (codes, n), in order, and the sums of their n, by a heap over the runs' heads."""
    if len(runs) == 1:
        return runs[0]
    merged = heapq.merge(*[zip(c.tolist(), n.tolist(), strict=True) for c, n in runs])
    codes, counts = array("q"), array("q")
    for code, same in groupby(merged, key=itemgetter(0)):
        codes.append(code)
        counts.append(sum(n for _, n in same))
    return np.frombuffer(codes, dtype=np.int64), np.frombuffer(counts, dtype=np.int64)


def highest(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair's count is its B id's highest; the pairs of a B id lie side by side."""
    if not len(codes):
        return np.zeros(0, dtype=bool)
    b = codes >> 16
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    return counts == np.repeat(np.maximum.reduceat(counts, at), np.diff(np.append(at, len(b))))


def _run_of(size: int, codes: bytes, n: bytes, width: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_loose(codes, "<u4", size), dtype=np.int64), _loose(n, width, size).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows (keys, columns) of each group, from rows that are sorted by ``keys``."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in keys + columns), strict=True))
    for _, own in groupby(rows, key=lambda r: r[: len(keys)]):
        yield list(own)


MERGED = "radix int, slice int, size int, codes binary, n binary, best binary"


def _merge_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(batches, ["radix", "slice"], ["size", "codes", "n"]):
        codes, n = merge_counts([_run_of(*r[2:]) for r in rows])
        yield _batch(MERGED, radix=[rows[0][0]], slice=[rows[0][1]], size=[len(codes)], codes=[_squeezed(np.diff(codes, prepend=0).astype("<u4"))], n=[_squeezed(n.astype("<u8"))])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(batches, ["radix"], ["size", "codes", "n"]):
        codes, n = merge_counts([_run_of(*r[1:], "<u8") for r in rows])
        yield _batch(MERGED, radix=[rows[0][0]], size=[len(codes)], codes=[_squeezed(np.diff(codes, prepend=0).astype("<u4"))], n=[_squeezed(n.astype("<u8"))], best=[_squeezed(highest(codes, n).astype("u1"))])


ANSWERS = "block long, radix int, size int, n binary, best binary"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by radix and slice, the table (null block) before the runs."""
    table = None
    for batch in batches:
        for radix, block, size, codes, n, best in zip(*(batch.column(c).to_pylist() for c in ("radix", "block", "size", "codes", "n", "best")), strict=True):
            if block is None:
                table = *_run_of(size, codes, n, "<u8"), _loose(best, "u1", size)
                continue
            at = np.searchsorted(table[0], np.cumsum(_loose(codes, "<u4", size), dtype=np.int64))
            yield _batch(ANSWERS, block=[block], radix=[radix], size=[size], n=[_squeezed(table[1][at].astype("<u8"))], best=[_squeezed(table[2][at])])


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's answers streamed into its documents; its records (radix -1) come first."""
    for rows in _grouped(batches, ["block"], ["radix", "size", "n", "best", "rows", "docs", "slots", "times", "n_docs", "n_codes", "n_records"]):
        docs, per_code, slots, times, n_docs, n_codes, n_records = rows[0][5:]
        counts, best = (np.concatenate([_loose(r[i], kind, r[2]) for r in rows[1:]]) for i, kind in ((3, "<u8"), (4, "u1")))
        of = np.repeat(np.arange(n_codes), _loose(per_code, "<u4", n_codes))
        times, slots = _loose(times, "<u4", n_records).astype(np.int64), _loose(slots, "<u2", n_records)
        sums = []
        for weight in (best.astype(np.int64)[of] * times, counts.astype(np.int64)[of] * times):
            out = np.zeros(n_docs, dtype=np.int64)
            np.add.at(out, slots, weight)
            sums.append(out)
        yield pa.RecordBatch.from_arrays([pa.array(_loose(docs, "<u8", n_docs).astype(np.int64)), *map(pa.array, sums)], names=["row", "n_best", "count_sum"])


def align_tokens(df: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = 240 << 20, block_links: int = BLOCK_LINKS, slice_chars: int = SLICE, fan: int = FAN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) a document."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run, schema = _blocks(a, b, cache_bytes, block_links, slice_chars)
    made = store(two(df, id_col, text_col).mapInArrow(run, schema), "alignment")
    with scratch(spark):
        n_slices = -(-made.where("n_codes is not null").count() // fan) or 1
        runs = made.where("radix is not null").select("radix", F.pmod(F.xxhash64("block"), F.lit(n_slices)).cast("int").alias("slice"), "block", "size", "codes", "n")
        merged = runs.drop("block").repartition(parts, "radix", "slice").sortWithinPartitions("radix", "slice").mapInArrow(_merge_slices, MERGED)
        tables = store(merged.select("radix", "size", "codes", "n").repartition(parts, "radix").sortWithinPartitions("radix").mapInArrow(_tables, MERGED).drop("slice"), "tables")
        spread = tables.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
        asked = spread.unionByName(runs, allowMissingColumns=True).repartition(parts, "radix", "slice").sortWithinPartitions("radix", "slice", F.asc_nulls_first("block"))
        answers = asked.mapInArrow(_answers, ANSWERS)
        records = made.where("n_codes is not null").select("block", F.lit(-1).alias("radix"), "rows", "docs", "slots", "times", "n_docs", "n_codes", "n_records")
        both = records.unionByName(answers, allowMissingColumns=True).repartition(parts, "block").sortWithinPartitions("block", "radix")
        back = store(both.mapInArrow(_back, "row long, n_best long, count_sum long"), "back", keep=True)
    names = [x.split()[0] for x in DOCS.split(", ")]
    docs = made.where("doc_id is not null or groups_sha256 is not null").select(*names)
    sums = back.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = docs.join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
