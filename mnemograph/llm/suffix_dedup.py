"""Repeated byte strings by a distributed merge sort of suffixes that never re-compares known prefixes.

Every byte that a ``length``-byte string covers which also starts anywhere else is removed. Sorting
all suffixes would move each byte hundreds of times, so suffixes are sampled so that none that
matters is lost: of every window of ``length`` bytes the 32-byte string with the smallest hash is its
anchor (leftmost of equals). Equal windows have equal anchors at the same offset, so only windows at
equal anchors need comparing.

1. Each task finds its texts' anchors. The windows of one anchor are consecutive; the bytes they
   cover are the anchor's block. Equal blocks have equal windows throughout: they are removed at
   once, in the task or after the anchors have met in a shuffle, and one of them stands for all.
2. Where different blocks share an anchor, they are sorted by the suffix that starts at the anchor.
   Each task sorts its own and writes front-coded runs (length shared with the one before, rest); the
   runs of a bucket meet and a loser tree merges them. It compares two suffixes only beyond the prefix
   that both are known to share, and yields the merged order with its common-prefix lengths.
3. Two suffixes share R bytes from the anchor on (the least of the lengths between them) and L bytes
   before it; their windows that lie within those bytes are equal. Anchors with very many different
   blocks are counted window by window instead, in an aggregation that combines before its shuffle.
4. The removed runs of a text are joined and cut out of it.

Defined cases: texts are UTF-8 bytes, null is empty; shorter texts than ``length`` lose nothing; rows
are texts of their own, so repeated rows (also with one doc_id) repeat each other's strings; null ids
give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import numbered, store

ANCHOR = 32
#: Windows handled at once, so that a place in them fits into 20 bits.
SPAN = 1 << 19
#: Blocks of one anchor that are merged in one task; anchors with more are counted by window.
HOT = 20_000
#: Suffixes that one merge task gets on average.
BUCKET = 40_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = SPAN + 4096
        with np.errstate(over="ignore"):
            for b in (_BASE, inverse):
                p = np.full(size, b, dtype=np.uint64)
                p[0] = 1
                _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def anchors(t: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, block hash, first window, last window, anchor place) of all windows of bytes ``t``."""
    n = len(t)
    with np.errstate(over="ignore"):
        h, step, p = _BYTES[t], 1, _BASE
        while step < ANCHOR:
            h = h[:-step] * p + h[step:]
            p, step = p * p, step * 2
        places = length - ANCHOR + 1
        v = _mix(h)
        key = (v >> np.uint64(20) << np.uint64(20)) | np.arange(len(v), dtype=np.uint64)
        width, m = 1, key
        while 2 * width <= places:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if places > width:
            m = np.minimum(m[: len(key) - places + 1], m[places - width : places - width + len(key) - places + 1])
        at = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        own = at[first]
        powers, back = _power_tables()
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(_BYTES[t] + np.uint64(1)) * powers[:n], dtype=np.uint64)])
        block = (sums[last + length] - sums[first]) * back[first]
        block = _mix(block ^ _mix(((last - first) << 16 | (own - first)).astype(np.uint64)))
    return v[own], block, first, last, own


ROWS = "kind byte, a long, c long, row long, lo int, hi int, at int"
#: Kinds: bytes lo..hi of a row are removed; an anchor (hash a, block hash c, windows lo..hi, place at),
#: alone in its task or standing for several; a block to compare, the only one of its kind or not.
REMOVED, ONE, SEVERAL, EDGE, FULL_EDGE = range(5)


def _batch(kind, a, c, row, lo, hi, at) -> pa.RecordBatch:
    n = len(row)
    full = lambda x, t: np.full(n, x, dtype=t) if np.isscalar(x) else np.asarray(x).astype(t)
    return pa.RecordBatch.from_arrays(
        [pa.array(full(kind, np.int8)), *(pa.array(full(x, np.int64)) for x in (a, c, row)), *(pa.array(full(x, np.int32)) for x in (lo, hi, at))],
        names=["kind", "a", "c", "row", "lo", "hi", "at"],
    )


def _collapse(parts: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Of equal blocks in this task one goes on; all of them are removed."""
    a, c, row, lo, hi, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((c, a))
    a, c, row, lo, hi, at = (x[order] for x in (a, c, row, lo, hi, at))
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    more = ~new | np.concatenate([~new[1:], [False]])
    if more.any():
        yield _batch(REMOVED, 0, 0, row[more], lo[more], hi[more] + length, 0)
    for i in range(0, len(a), 200_000):
        s = slice(i, i + 200_000)
        g = new[s]
        yield _batch(np.where(more[s][g], SEVERAL, ONE), a[s][g].view(np.int64), c[s][g].view(np.int64), row[s][g], lo[s][g], hi[s][g], at[s][g])


def _sign(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                whole = np.frombuffer((text or "").encode(), dtype=np.uint8)
                for begin in range(0, len(whole) - length + 1, SPAN):
                    a, c, lo, hi, at = anchors(whole[begin : begin + SPAN + length - 1], length)
                    parts.append((a, c, np.full(len(a), row, dtype=np.int64), lo + begin, hi + begin, at + begin))
                    held += len(a)
            if held > 3_000_000:
                yield from _collapse(parts, length)
                parts, held = [], 0
        if parts:
            yield from _collapse(parts, length)

    return run


def _meet(length: int):
    """Rows sorted by (a, c): equal blocks are removed, and different ones at an anchor are noted.

    A class is a run of rows with one (a, c). Only the rows around a batch's end are carried over.
    """

    def classes(cols: list[np.ndarray], final: bool) -> tuple[list[pa.RecordBatch], list[np.ndarray]]:
        kind, a, c, row, lo, hi, at = cols
        out: list[pa.RecordBatch] = []
        plain = kind == REMOVED
        if plain.any():
            out.append(_batch(REMOVED, 0, 0, row[plain], lo[plain], hi[plain], 0))
            kind, a, c, row, lo, hi, at = (x[~plain] for x in (kind, a, c, row, lo, hi, at))
        if not len(a):
            return out, [kind, a, c, row, lo, hi, at]
        new_class = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
        # hold back the last class, and the one before it where the anchor goes on
        starts = np.flatnonzero(new_class)
        keep_from = len(a) if final else starts[-1]
        group = np.cumsum(new_class) - 1
        several = np.bincount(group, weights=(kind == SEVERAL) | (kind == FULL_EDGE) | (kind == EDGE) * 0) > 0
        full = several | (np.bincount(group) > 1)
        anchor = np.cumsum(new_anchor) - 1
        mixed = np.bincount(anchor[starts]) > 1
        done = np.arange(len(a)) < keep_from
        # rows that stood for several, or were marked before, are removed already
        gone = done & full[group] & (kind == ONE)
        if gone.any():
            out.append(_batch(REMOVED, 0, 0, row[gone], lo[gone], hi[gone] + length, 0))
        edge = done & new_class & mixed[anchor] & (kind != EDGE) & (kind != FULL_EDGE)
        if edge.any():
            out.append(_batch(np.where(full[group[edge]], FULL_EDGE, EDGE), a[edge], c[edge], row[edge], lo[edge], hi[edge], at[edge]))
        # carried: the open class, and a mark of the class before it if that has the same anchor
        rest = np.flatnonzero(~done)
        if not final and keep_from > 0 and a[keep_from - 1] == a[keep_from]:
            mark = starts[-2]
            if mixed[anchor[mark]]:
                kind = kind.copy()
                kind[mark] = FULL_EDGE if full[group[mark]] else EDGE  # noted already
                rest = np.concatenate([[mark], rest])
        if len(rest) > 4:  # of a long open class two rows are enough; the others are removed now
            own = rest[np.flatnonzero(~done[rest])[0] :] if done[rest[0]] else rest
            late = own[2:]
            ones = late[kind[late] == ONE]
            if len(ones):
                out.append(_batch(REMOVED, 0, 0, row[ones], lo[ones], hi[ones] + length, 0))
            rest = np.concatenate([rest[: len(rest) - len(own)], own[:2]])
        return out, [x[rest] for x in (kind, a, c, row, lo, hi, at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            cols = [np.asarray(x) for x in batch.columns]
            if carried is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(carried, cols, strict=True)]
            out, carried = classes(cols, False)
            yield from out
        if carried is not None:
            yield from classes(carried, True)[0]

    return run


def front_code(items: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run: per suffix the length shared with the one before and the rest, then a payload."""
    out, before = bytearray(), b""
    for suffix, payload in items:
        same = common_prefix(before, suffix, 0)
        out += same.to_bytes(2, "little") + (len(suffix) - same).to_bytes(2, "little") + len(payload).to_bytes(2, "little")
        out += suffix[same:] + payload
        before = suffix
    return bytes(out)


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes needn't be looked at."""
    n = min(len(x), len(y))
    if x[known:n] == y[known:n]:
        return n
    lo, hi = known, n  # x and y agree on lo bytes and differ within hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(length shared with the one before, suffix, payload) of a front-coded run."""
    at, before = 0, b""
    while at < len(blob):
        same, rest, extra = (int.from_bytes(blob[at + i : at + i + 2], "little") for i in (0, 2, 4))
        at += 6
        suffix = before[:same] + blob[at : at + rest]
        at += rest
        yield same, suffix, blob[at : at + extra]
        at += extra
        before = suffix


def merge_runs(runs: list[Iterator[tuple[int, bytes, bytes]]]) -> Iterator[tuple[int, bytes, bytes]]:
    """Merge sorted runs by a loser tree that holds common-prefix lengths with the last winner.

    Of two candidates the one that shares more with the last winner is smaller; only equal lengths
    need bytes compared, and only beyond that length. Yields (length shared with the suffix yielded
    before, suffix, payload).
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    shared = [0] * k  # with the last winner
    losers = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's ``shared`` becomes its length shared with the winner."""
        if heads[x] is None or heads[y] is None:
            return (y, x) if heads[x] is None else (x, y)
        if shared[x] != shared[y]:
            # the one that leaves the last winner later is smaller, and the other keeps its length
            return (x, y) if shared[x] > shared[y] else (y, x)
        a, b = heads[x][1], heads[y][1]
        same = common_prefix(a, b, shared[x])
        won, lost = (x, y) if a[same : same + 1] <= b[same : same + 1] else (y, x)
        shared[lost] = same
        return won, lost

    winners = list(range(k))
    node, level = k, winners
    while len(level) > 1:
        up = []
        node //= 2
        for i in range(0, len(level), 2):
            won, lost = play(level[i], level[i + 1])
            losers[node + i // 2] = lost
            up.append(won)
        level = up
    best = level[0]
    while heads[best] is not None:
        _, suffix, payload = heads[best]
        yield shared[best], suffix, payload
        heads[best] = next(runs[best], None) if best < len(runs) else None
        shared[best] = heads[best][0] if heads[best] is not None else 0
        node = (best + k) // 2
        while node:
            won, lost = play(best, losers[node])
            losers[node], best = lost, won
            node //= 2


#: Payload: row, anchor place, first and last window (8 + 3 * 4 bytes), full or not, left bytes backward.
_HEAD = 21


def _payload(row: int, at: int, lo: int, hi: int, full: bool, left: bytes) -> bytes:
    return row.to_bytes(8, "little") + b"".join(x.to_bytes(4, "little") for x in (at, lo, hi)) + bytes([full]) + left[::-1]


def compare_group(group: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, int, int]]:
    """(row, from, to) of what blocks at one anchor repeat of each other.

    ``group``: in suffix order, the length shared with the one before, and the payload.
    """
    n = len(group)
    infos = []
    for _, p in group:
        at, lo, hi = (int.from_bytes(p[i : i + 4], "little") for i in (8, 12, 16))
        infos.append((int.from_bytes(p[:8], "little"), at, lo, hi, p[20], p[_HEAD:]))

    def give(i: int, longest: int, shortest: int) -> Iterator[tuple[int, int, int]]:
        row, at, lo, hi, full, _ = infos[i]
        most, least = min(longest, at - lo), max(shortest, at - hi)
        if most >= least and not full:
            yield row, at - most, at - least + length

    if n <= 12:
        for i in range(n):
            right = 1 << 30
            for j in range(i + 1, n):
                right = min(right, group[j][0])
                if infos[i][4] and infos[j][4]:
                    continue
                left = common_prefix(infos[i][5], infos[j][5], 0)
                if left + right >= length:
                    yield from give(i, left, length - right)
                    yield from give(j, left, length - right)
        return
    shared = np.array([g[0] for g in group])
    shared[0] = 0
    for o in range(min(x[1] - x[3] for x in infos), max(x[1] - x[2] for x in infos) + 1):
        part = np.cumsum(shared < length - o).tolist()
        same: dict[tuple[int, bytes], list[int]] = defaultdict(list)
        for i, (_, at, lo, hi, _, left) in enumerate(infos):
            if at - hi <= o <= at - lo:
                same[part[i], left[:o]].append(i)
        for members in same.values():
            if len(members) > 1:
                for i in members:
                    yield from give(i, o, o)


def removed_runs(docs: DataFrame, length: int) -> DataFrame:
    """(row, lo, hi): byte runs of the rows of ``docs`` (row, doc_id, text) that are to go."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = docs.select("row", "text").mapInArrow(_sign(length), ROWS)
    spread = met.repartition(parts, F.when(F.col("kind") == REMOVED, F.xxhash64("row", "lo")).otherwise(F.col("a")))
    found = store(spread.sortWithinPartitions("a", "c", "kind", "row", "lo").mapInArrow(_meet(length), ROWS), "blocks")
    gone = found.where(F.col("kind") == REMOVED).select("row", "lo", "hi")

    edges = found.where(F.col("kind") >= EDGE)
    sizes = store(edges.groupBy("a").agg(F.count("*").alias("size")), "anchors")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    if not total:
        return gone
    buckets = -(-total // BUCKET)
    listed = edges.join(sizes, "a").groupBy("row").agg(F.collect_list(F.struct("a", "lo", "hi", "at", (F.col("kind") == FULL_EDGE).alias("full"), (F.col("size") > HOT).alias("hot"))).alias("blocks"))
    texts = docs.repartition(parts, "row").join(listed, "row").select("row", "text", "blocks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This task's sorted, front-coded run for each bucket; windows of hot anchors by fingerprint."""
        from pyspark import TaskContext

        run_id, waiting, held = TaskContext.get().partitionId(), defaultdict(list), 0
        names = ["bucket", "run", "blob", "o", "fp", "row", "at", "full"]

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, items in sorted(waiting.items()):
                items.sort()
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([run_id], pa.int32()), pa.array([front_code(items)], pa.binary()), *(pa.array([None], t) for t in (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.bool_()))], names=names)
            waiting.clear()

        for batch in batches:
            hot = []
            for row, text, blocks in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                raw = text.encode()
                for b in blocks:
                    at, lo, hi = b["at"], b["lo"], b["hi"]
                    if b["hot"]:
                        hot += [(at - p, hashlib.blake2b(raw[p : p + length], digest_size=16).digest(), row, at, b["full"]) for p in range(lo, hi + 1)]
                        continue
                    waiting[b["a"] % buckets].append((raw[at : hi + length], _payload(row, at, lo, hi, b["full"], raw[lo:at])))
                    held += 1
                if held > 200_000:
                    yield from flush()
                    held = 0
            if hot:
                o, fp, row, at, full = zip(*hot, strict=True)
                n = len(hot)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(o, pa.int32()), pa.array(fp, pa.binary()), pa.array(row, pa.int64()), pa.array(at, pa.int32()), pa.array(full, pa.bool_())], names=names)
        yield from flush()

    runs = texts.mapInArrow(cut, "bucket long, run int, blob binary, o int, fp binary, row long, at int, full boolean")
    any_hot = not sizes.where(F.col("size") > HOT).isEmpty()
    if any_hot:
        runs = store(runs, "runs")

    def merge(pdf):
        import pandas as pd

        found, group, key = [], [], None
        for same, suffix, payload in merge_runs([read_run(b) for b in pdf["blob"]]):
            if same < ANCHOR or key != suffix[:ANCHOR]:
                if len(group) > 1:
                    found += compare_group(group, length)
                group, key = [], suffix[:ANCHOR]
            group.append((same, payload))
        if len(group) > 1:
            found += compare_group(group, length)
        return pd.DataFrame(found, columns=["row", "lo", "hi"]).astype({"row": "int64", "lo": "int32", "hi": "int32"})

    out = gone.unionByName(runs.where(F.col("blob").isNotNull()).select("bucket", "blob").groupBy("bucket").applyInPandas(merge, "row long, lo int, hi int"))
    if any_hot:
        windows = runs.where(F.col("fp").isNotNull())
        again = windows.groupBy("o", "fp").count().where(F.col("count") > 1).select("o", "fp")
        hits = windows.where(~F.col("full")).join(again, ["o", "fp"]).select("row", (F.col("at") - F.col("o")).alias("lo"), (F.col("at") - F.col("o") + length).alias("hi"))
        out = out.unionByName(hits)
    return out


def dedup_suffixes(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, the kept bytes."""
    if length < 2 * ANCHOR or length > 4000:
        raise ValueError("length must be between 64 and 4000")
    docs = numbered(df, id_col, text_col)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = removed_runs(docs, length).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    both = docs.repartition(parts, "row").join(runs, "row", "left").select("doc_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                raw = (text or "").encode()
                kept, at, spans, removed = [], 0, 0, 0
                end = -1
                for lo, hi in sorted((r["lo"], r["hi"]) for r in runs or ()):
                    if lo > end:
                        spans += 1
                        kept.append(raw[at:lo])
                        removed += hi - lo
                    elif hi > end:
                        removed += hi - end
                    end = max(end, hi)
                    at = end
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            arrays = [batch.column("doc_id"), *map(pa.array, cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names=names[: 5 + with_text])

    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
