"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles, as 64-bit hashes. Hash ranges cut the space into segments;
a segment's sketch is the XOR of its shingles' bits, so segments that no shingle of the symmetric
difference falls into have equal sketches, and the Hamming distance of two sketches never exceeds the
symmetric difference. For sets of n and n' >= n shingles that link, the difference is at most
``most_different(n)``; a document therefore gives its first ``most_different(n) + 1 + spare`` segments
of its size band as signatures, and any linking partner of the same or a larger size shares one of
them that isn't empty (a band's ``spare`` segments pay for empty ones; documents with more empty ones
than that give the empty ones too). Sizes near a band's upper edge are in the next band as well, so every
linking pair has a band in common.

Signatures meet in a shuffle. Each task first collapses its own copies and hot signatures, so a
signature has at most ``SMALL + 1`` rows a task. Groups of up to ``SMALL`` documents give all pairs;
larger ones give a star to their smallest member and are noted. Equal sets meet by their 96-bit
digests and one of them stands for all. Candidate pairs are verified on the whole sets: first one
pair for each document, then those pairs that components don't join yet, so the sets of a group
move once or twice and not once a pair.

Linking documents share at least ``1 + spare`` equal segments in a band, less a document's empty ones. So
groups count under how many signatures a pair meets: a pair that meets under fewer than that, less
the document's noted signatures, doesn't link and goes. Without this, long documents, which have thousands
of signatures, would meet all others that share a few words. A document with fewer noted
signatures in a band than that meets each partner of that band under another
signature, and leaves the band's noted groups. This takes out documents that share a passage but
little else. Sketches and sets are shuffled only for the rows in pairs, found by a filter of fixed size. Where what is left of a noted group isn't one component, its members are compared with a
pivot, and regrouped by the shingles in which they differ from it (``_across``): a group costs its size
at each level, not its square. Components are found by ``smallest_reachable``.

Defined cases: A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; with fewer words than a shingle
takes, the whole sequence is the only one; null, empty and wordless texts have no shingles and no
links. Null doc_ids are rows like others (a component whose ids are all null is null). Repeated ids
give a row each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import fresh, joined, numbered, scratch, smallest_reachable, stable, store, take_over

SMALL, RATIO = 12, 1.6
#: One spare segment for so many that may differ.
SPARE = 8
#: Members of a group whose pairs are looked at one by one; of larger groups, this many at a time after so
#: many times of regrouping.
FEW, CHUNK, LEVELS = 256, 4000, 3
#: Words of the short sketches that pairs are tried on, and bits of the filter on rows that are in pairs.
SKETCH_WORDS, FILTER_BITS = 32, 1 << 25
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 150_000) -> None:
        self.known, self.most = {}, most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.known) > self.most:
                self.known.clear()
            for w in {*words}:
                if w not in self.known:
                    self.known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


_hashes = WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h, take = _hashes(words), min(k, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - take + 1, take, dtype=np.uint64)
        for i in range(take):
            out = _mix(out * _P + h[i : len(words) - take + 1 + i])
    return np.unique(out)


class Rule:
    """Link if ``den * intersection >= num * union``; all bounds in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def largest_partner(self, n: int) -> int:
        return self.den * n // self.num

    def links(self, a: int, b: int, both: int) -> bool:
        return both > 0 and self.den * both >= self.num * (a + b - both)

    def difference(self, a: int, b: int) -> int:
        """The symmetric difference of linking sets of these sizes is at most this."""
        both = -(-self.num * (a + b) // (self.den + self.num))
        return a + b - 2 * both

    def most_different(self, n: int) -> int:
        """... of a set of n and any linking set that isn't smaller."""
        m = self.largest_partner(n)
        return max(self.difference(n, m), self.difference(n, max(n, m - 1)))


def band_edges(rule: Rule, upto: int) -> list[int]:
    """Smallest sizes of the bands; within a band the segments are the same."""
    edges = [1]
    while edges[-1] <= upto:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
    return edges


def bands_of(n: int, rule: Rule, edges: list[int]) -> list[int]:
    """The band of n, and every later one that a linking partner may be in."""
    first = int(np.searchsorted(edges, n, side="right")) - 1
    last = int(np.searchsorted(edges, rule.largest_partner(n), side="right")) - 1
    return list(range(first, last + 1))


def segment_sketches(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Parity sketch, 64 bits a segment: each shingle flips one bit of its hash range's segment."""
    own = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    bits = np.uint64(1) << (_mix(hashes) >> np.uint64(58))
    out = np.zeros(segments, dtype=np.uint64)
    np.bitwise_xor.at(out, own.astype(np.int64), bits)
    return out


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of ``words`` segments, from one of a multiple of them."""
    return np.bitwise_xor.reduce(sketch.reshape(words, -1), axis=1)


def doc_sketch(hashes: np.ndarray) -> bytes:
    """A sketch of SKETCH_WORDS words; after it, for sets of more shingles than it has bits, one of a bit a shingle.

    In too few bits, the distance of unlike sets ends at half the bits, below what long sets may differ.
    """
    words = SKETCH_WORDS
    while words * 64 < len(hashes):
        words *= 2
    whole = segment_sketches(hashes, words)
    return whole.tobytes() if words == SKETCH_WORDS else fold(whole, SKETCH_WORDS).tobytes() + whole.tobytes()


def long_distance(x: bytes, y: bytes) -> int:
    """The distance of two documents' long sketches."""
    a, b = (np.frombuffer(s, dtype=np.uint64)[SKETCH_WORDS:] for s in (x, y))
    words = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum(dtype=np.int64))


def signatures(hashes: np.ndarray, rule: Rule, edges: list[int]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(signatures, least shared): the band is in a signature's low bits; per band how many signatures
    any linking partner shares at least."""
    n, out, least = len(hashes), [], []
    mixed = _mix(hashes)
    for band in bands_of(n, rule, edges):
        most = rule.most_different(max(edges[band + 1] - 1, n))
        spare = 0 if most <= 1 else 1 if most <= 4 else 2 + most // SPARE
        segments = most + 1 + spare
        own = (((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)
        # 64-bit content of each segment: the XOR of its shingles' mixed hashes
        content = np.zeros(segments, dtype=np.uint64)
        np.bitwise_xor.at(content, own, mixed)
        give = min(segments, rule.most_different(n) + 1 + spare)
        numbers = np.arange(give, dtype=np.uint64)
        full = np.bincount(own, minlength=segments)[:give] > 0
        empty = int((~full).sum())
        use = full if empty <= spare else np.ones(give, dtype=bool)
        least.append((band, 1 + spare - empty if empty <= spare else 1))
        with np.errstate(over="ignore"):
            sig = _mix(content[:give][use] ^ _mix(numbers[use] * _P + np.uint64(band + 1)))
        out.append(sig >> np.uint64(6) << np.uint64(6) | np.uint64(band & 63))
    return np.concatenate(out), least


ROWS = "kind byte, a long, b long, n int, sketch binary"
#: Kinds of rows: document (doc_id, row, size, sketch), signature (signature, row, size), equal sets (row, row),
#: candidate pair (row, row, 64 times the small groups it meets in, and the band), member of a large group (signature,
#: row), digest (first 64 bits, row, 32 more), signatures that partners share at least (band, row, number).
DOC, SIG, SAME, PAIR, MEMBER, DIGEST, LEAST = range(7)


def _rows(kind: int, a, b, n=None, sketch=None) -> pa.RecordBatch:
    size = len(b)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, dtype=np.int8)), a if isinstance(a, pa.Array) else pa.array(np.asarray(a, dtype=np.int64)), pa.array(np.asarray(b, dtype=np.int64)), pa.array(np.zeros(size) if n is None else n, pa.int32()), pa.nulls(size, pa.binary()) if sketch is None else pa.array(sketch, pa.binary())],
        names=["kind", "a", "b", "n", "sketch"],
    )


def _sign(k: int, rule: Rule):
    """Documents to rows of the kinds above; copies and hot signatures collapse in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("jaccard", _hashes.known.clear)
        edges, sigs, owners, counts, seen, held = band_edges(rule, 1 << 20), [], [], [], {}, 0
        for batch in batches:
            sizes, sketches, same, digests, least = [], [], [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = shingles(text, k)
                sizes.append(len(own))
                sketches.append(doc_sketch(own) if len(own) else None)
                if not len(own):
                    continue
                digest = xxhash.xxh3_128_digest(own.tobytes())
                if digest in seen:
                    same.append((seen[digest], row))
                    continue
                seen[digest] = row
                digests.append((int.from_bytes(digest[:8], "little", signed=True), row, int.from_bytes(digest[8:12], "little", signed=True)))
                while edges[-1] <= rule.largest_partner(len(own)):
                    edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
                s, shared = signatures(own, rule, edges)
                least += [(band, row, t) for band, t in shared if t > 1]
                sigs.append(s)
                owners.append(np.full(len(s), row, dtype=np.int64))
                counts.append(np.full(len(s), len(own), dtype=np.int32))
                held += len(s)
            yield _rows(DOC, batch.column("doc_id"), batch.column("row"), sizes, sketches)
            if same:
                yield _rows(SAME, *zip(*same, strict=True))
            if least:
                a, b, n = zip(*least, strict=True)
                yield _rows(LEAST, a, b, np.array(n, dtype=np.int32))
            if digests:
                a, b, n = zip(*digests, strict=True)
                yield _rows(DIGEST, a, b, np.array(n, dtype=np.int32))
            if held > 1_000_000:
                yield from _collapse(np.concatenate(sigs), np.concatenate(owners), np.concatenate(counts), rule)
                sigs, owners, counts, held, seen = [], [], [], 0, {}
        if sigs:
            yield from _collapse(np.concatenate(sigs), np.concatenate(owners), np.concatenate(counts), rule)

    return run


def _collapse(sigs: np.ndarray, owners: np.ndarray, sizes: np.ndarray, rule: Rule) -> Iterator[pa.RecordBatch]:
    """Of a signature's rows in this task, the first SMALL + 1 go on; later ones join the first."""
    order = np.lexsort((owners, sigs))
    sigs, owners, sizes = sigs[order].view(np.int64), owners[order], sizes[order]
    starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    group = np.cumsum(np.concatenate([[True], sigs[1:] != sigs[:-1]])) - 1
    place = np.arange(len(sigs)) - starts[group]
    go = place <= SMALL
    for lo in range(0, int(go.sum()), 200_000):
        yield _rows(SIG, sigs[go][lo : lo + 200_000], owners[go][lo : lo + 200_000], sizes[go][lo : lo + 200_000])
    late = ~go
    if late.any():
        first = starts[group[late]]
        near = rule.den * np.minimum(sizes[first], sizes[late]).astype(np.int64) >= rule.num * np.maximum(sizes[first], sizes[late]).astype(np.int64)
        pairs = np.unique(np.stack([owners[first], owners[late], sigs[late] & 63], axis=1)[near], axis=0)
        yield _rows(PAIR, pairs[:, 0], pairs[:, 1], pairs[:, 2].astype(np.int32))
        yield _rows(MEMBER, sigs[late], owners[late])


def _pair_up(rule: Rule):
    """Rows sorted by (kind, a, b): signature groups become pairs, a star or members of a large group."""

    def near(x: tuple[int, int], y: tuple[int, int]) -> bool:
        return rule.den * min(x[1], y[1]) >= rule.num * max(x[1], y[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, large, last = None, [], False, None
        out: dict[tuple[int, int, int], int] = {}  # (row, row, band): small groups that both are in
        noted: list[tuple[int, int]] = []
        for batch in _ended(batches):
            if batch is None:
                keys, rows, sizes = [None], [0], [0]  # closes the last group
            else:
                kind = np.asarray(batch.column("kind"))
                other = batch.filter(pa.array(kind != SIG))
                if other.num_rows:
                    yield other
                own = batch.filter(pa.array(kind == SIG))
                if not own.num_rows:
                    continue
                a, b, n = (np.asarray(own.column(c)) for c in ("a", "b", "n"))
                # most signatures have one row and need no look; a batch's ends may go on elsewhere
                lone = np.concatenate([[False], a[1:] != a[:-1]]) & np.concatenate([a[1:] != a[:-1], [False]])
                keys, rows, sizes = (x[~lone].tolist() for x in (a, b, n))
            for sig, row, size in zip(keys, rows, sizes, strict=True):
                if sig != group:
                    if not large:
                        for x, y in combinations(members, 2):
                            if near(x, y):
                                met = x[0], y[0], group & 63
                                out[met] = out.get(met, 0) + 1
                    group, members, large, last = sig, [(row, size)], False, row
                elif row != last:
                    last = row
                    if large:
                        noted.append((sig, row))
                        if near(members[0], (row, size)):
                            out.setdefault((members[0][0], row, sig & 63), 0)
                        continue
                    members.append((row, size))
                    if len(members) > SMALL:
                        large = True
                        for m in members[1:]:
                            if near(members[0], m):
                                out.setdefault((members[0][0], m[0], sig & 63), 0)
                        noted += [(sig, m[0]) for m in members]
                        members = members[:1]
            if out and (len(out) > 100_000 or batch is None):
                a, b, n = zip(*sorted((a, b, c << 6 | band) for (a, b, band), c in out.items()), strict=True)
                yield _rows(PAIR, a, b, np.array(n, dtype=np.int32))
                out = {}
            if noted and (len(noted) > 100_000 or batch is None):
                yield _rows(MEMBER, *zip(*noted, strict=True))
                noted = []

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def _row_filter(rows: DataFrame) -> np.ndarray:
    """A bit for the hash of each of ``rows``; its size is fixed, whatever their number."""
    place = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    words = rows.select((place / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    """(row) of both ends of the ``pairs`` (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("row"))


def _flagged(df: DataFrame, col: str, rows: DataFrame, flag: str) -> DataFrame:
    """``df`` with a column ``flag``: whether the row number in ``col`` is one of ``rows`` (a few more share a filter bit).

    The filter comes by broadcast, in up to FILTER_BITS / 32768 rows of 4 KB, whatever the number of ``rows``; ``df`` isn't
    shuffled, and no Python worker is needed beside those of the step.
    """

    def place(c: str):
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    part, bits = fresh(df, "filter_part"), fresh(df, "filter_bits")
    built = rows.groupBy((place("row") / 32768).cast("int").alias(part)).agg(F.bitmap_construct_agg(place("row") % 32768).alias(bits))
    byte = F.substring(F.col(bits), (place(col) % 32768 / 8).cast("int") + 1, F.lit(1))
    is_set = F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), (place(col) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    joined_up = df.withColumn(part, (place(col) / 32768).cast("int")).join(F.broadcast(built), part, "left")
    return joined_up.withColumn(flag, F.coalesce(is_set, F.lit(False))).drop(part, bits)


def _among(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` (row, ...) without the most that aren't of ``rows`` (row)."""
    return _flagged(df, "row", rows, "among").where("among").drop("among")


def _sets(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(row, set) of ``rows`` (and a few more that share a filter bit)."""
    shared = docs.sparkSession.sparkContext.broadcast(_row_filter(rows))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("jaccard", _hashes.known.clear)
        for batch in batches:
            place = np.asarray(batch.column("place"))
            wanted = (shared.value[place // 32] >> (place % 32).astype(np.uint32)) & np.uint32(1) == 1
            some = batch.filter(pa.array(wanted))
            own = [shingles(t, k).tobytes() for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(own, pa.binary())], names=["row", "set"])

    placed = docs.select("row", "text", F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS)).alias("place"))
    return store(placed.mapInArrow(sets, "row long, set binary"), "sets")


def _close(rule: Rule, n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes whose sketches are so far apart may link."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    both = -(-rule.num * (n + m) // (rule.den + rule.num))
    return (apart <= n + m - 2 * both) & (rule.den * np.minimum(n, m) >= rule.num * np.maximum(n, m))


def _sketch_pairs(sketched: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, apart) of the ``pairs`` (a, b) whose sketches are near enough for a link."""

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb, na, nb = batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            x, y = (np.frombuffer(b"".join(s[: 8 * SKETCH_WORDS] for s in k), dtype=np.uint64).reshape(-1, SKETCH_WORDS) for k in (ka, kb))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            for i in np.flatnonzero(_close(rule, na, nb, apart) & (np.minimum(na, nb) > 64 * SKETCH_WORDS)):
                apart[i] = long_distance(ka[i], kb[i])
            keep = _close(rule, na, nb, apart)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart.astype(np.int32))], names=["a", "b", "apart"]).filter(pa.array(keep))

    sketched = _among(sketched, _ends(pairs))
    tried = pairs.join(sketched.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka")), "a")
    tried = tried.join(sketched.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb")), "b")
    return store(tried.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(distance, CLOSE), "close")


CLOSE = "a long, b long, apart int"


def _with_sets(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their sets (sa, sb)."""
    held = _among(held, _ends(pairs))
    left = pairs.join(held.select(F.col("row").alias("a"), F.col("set").alias("sa")), "a")
    return left.join(held.select(F.col("row").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")


def _verify(pairs: DataFrame, held: DataFrame, rule: Rule, roots: DataFrame | None) -> DataFrame:
    """The components ``roots`` after all links among the ``pairs`` (a, b, apart). ``held``: the sets of all
    rows of the pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if x == y:
                    keep.append(True)
                elif rule.den * min(len(a), len(b)) < rule.num * max(len(a), len(b)):
                    keep.append(False)
                else:
                    keep.append(rule.links(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def linking(some: DataFrame) -> DataFrame:
        return store(_with_sets(some, held).mapInArrow(compare, "a long, b long"), "linked")

    # the nearest partner of each row first: most rows need no other
    first = store(pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b"), "first")
    roots = joined(roots, linking(first))
    # pairs that were tried without a link, or whose ends have met by now, go
    rest = pairs.join(first, ["a", "b"], "left_anti").select("a", "b")
    for c in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    rest = store(rest.where("ra != rb").select("a", "b"), "rest")
    return roots if rest.isEmpty() else joined(roots, linking(rest))


#: Sides of a group's members by their pivot: any, linked to it, unlinked (first keys, further keys).
ANY, INNER, OUTER, FURTHER = range(4)
EDITS = "kind byte, a long, b long"


def edit_keys(rule: Rule, x: np.ndarray, p: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    """(linked, keys, sides) of a set ``x`` by its pivot ``p``, both sorted.

    Write e(x) for the symmetric difference of x and the pivot. A linking pair x, y has
    |e(x)| + |e(y)| - 2 |e(x) & e(y)| = |x ^ y| <= difference(x, y). If one of them isn't linked to the pivot,
    its |e| is over ``difference(x, p)``, which bounds the overlap of e(x) and e(y) from below, so
    their first elements in one order (added ones, then missing ones) meet: the usual prefix rule.
    Only pairs whose e don't overlap are left; then one of them has very few elements, and they
    meet under the key 0.
    """
    at = np.searchsorted(p, x)
    at[at == len(p)] = 0
    same = p[at] == x
    missing = np.ones(len(p), dtype=bool)
    missing[at[same]] = False
    e = np.concatenate([x[~same], p[missing]])
    a, both = len(e), int(same.sum())
    linked = rule.links(len(x), len(p), both)
    slope = (rule.den - rule.num) / (rule.den + rule.num)
    upto = rule.most_different(len(x)) + 1
    short = min(a, upto, a - max(1, int(np.ceil(((1 - slope) * a - 2) / 2))) + 1)
    keys, sides = e[:short], np.full(short, INNER if linked else OUTER, dtype=np.int8)
    if not linked and min(a, upto) > short:
        keys = e[: min(a, upto)]
        sides = np.concatenate([sides, np.full(len(keys) - short, FURTHER, dtype=np.int8)])
    few = int(2 / (1 - slope)) + 1
    most = lambda s: max(s - 2 * -(-rule.num * s // (rule.den + rule.num)), s - 1 - 2 * -(-rule.num * (s - 1) // (rule.den + rule.num)))
    if a <= few or not linked and any(a + b <= most(len(x) + len(p) + b) for b in range(1, few + 1)):
        keys, sides = np.append(keys, np.uint64(0)), np.append(sides, np.int8(INNER if linked else OUTER))
    return linked, keys, sides


def _edits(rule: Rule):
    """Star pairs with their sets to links (kind -1) and members (kind: side, key, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, a, b = [], [], []
            for row, pivot, sx, sp in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sa", "sb")), strict=True):
                linked, keys, sides = edit_keys(rule, np.frombuffer(sx, dtype=np.uint64), np.frombuffer(sp, dtype=np.uint64))
                with np.errstate(over="ignore"):
                    keys = _mix(keys ^ _mix(np.uint64(pivot) * _P + np.uint64(1)))
                kinds.append(sides)
                a.append(keys.view(np.int64))
                b.append(np.full(len(keys), row, dtype=np.int64))
                if linked:
                    kinds.append(np.array([-1], dtype=np.int8))
                    a.append(np.array([min(row, pivot)], dtype=np.int64))
                    b.append(np.array([max(row, pivot)], dtype=np.int64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, a, b)], names=["kind", "a", "b"])

    return run


def _meet(rule: Rule):
    """Rows (key, i, j, chunk, side, row, root, n, sketch) sorted by (key, i, j): pairs across components that
    the sides and sketches allow. Two chunks of a group at a time are held."""

    def pairs(group: list[tuple]) -> list[tuple[int, int, int]]:
        chunk, side, row, root, n = (np.array([g[c] for g in group], dtype=np.int64) for c in range(3, 8))
        s = np.frombuffer(b"".join(g[8] for g in group), dtype=np.uint64).reshape(-1, SKETCH_WORDS)
        out = []
        for x in range(len(group) - 1):
            # only rows that may pair are compared
            other = side[x + 1 :]
            asked = (other != side[x]) & ((other == INNER) | (side[x] == INNER)) | (other == side[x]) & (side[x] != INNER) & (side[x] != FURTHER)
            asked &= (root[x + 1 :] != root[x]) & ((chunk[x + 1 :] != chunk[x]) | (group[x][1] == group[x][2]))
            at = x + 1 + np.flatnonzero(asked)
            apart = np.bitwise_count(s[at] ^ s[x]).sum(axis=1, dtype=np.int64)
            near = _close(rule, n[at], np.full(len(at), n[x]), apart)
            out += [(min(row[x], y), max(row[x], y), d) for y, d in zip(row[at][near].tolist(), apart[near].tolist(), strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], set()
        for batch in _ended(batches):
            for r in [(None,) * 3] if batch is None else zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "chunk", "side", "row", "root", "n", "sketch")), strict=True):
                if group and r[:3] != group[0][:3]:
                    out.update(pairs(group))
                    group = []
                group.append(r)
            if out and (batch is None or len(out) > 100_000):
                a, b, d = zip(*sorted(out), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int32())], names=["a", "b", "apart"])
                out = set()

    return run


def _across(docs: DataFrame, sketched: DataFrame, members: DataFrame, roots: DataFrame, k: int, rule: Rule) -> DataFrame:
    """The components after every link within the groups ``members`` (key, row) is found.

    A group that isn't one component and has more than ``FEW`` members gets a pivot, the member with most
    noted keys; all compare with it, and what differs from it makes the keys of smaller groups (see
    ``edit_keys``), which are treated alike, ``LEVELS`` times at most. The sketches of the members
    of the other open groups are compared across components, two chunks at a time.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members, held = members.withColumn("side", F.lit(ANY).cast("byte")), None

    def still_open(rows: DataFrame) -> DataFrame:
        placed = rows.select("key", "side", "row").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        sizes = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo != hi")
        return placed.join(sizes.select("key", "size"), "key")

    for level in range(LEVELS + 1):
        rest = store(still_open(members), "open")
        if rest.isEmpty():
            return roots
        if held is None:  # later members are some of these
            held = _sets(docs, rest.select("row"), k)
            sketched = _among(sketched, rest.select("row"))
        many, found = rest.where(F.col("size") > FEW), None
        if not many.isEmpty():
            keys = many.groupBy("row").agg(F.count("*").alias("keys"))
            pivots = many.select("key", "row").join(keys, "row").groupBy("key").agg(F.min_by("row", F.struct(-F.col("keys"), F.col("row"))).alias("b"))
            star = many.select("key", F.col("row").alias("a")).join(pivots, "key").where("a != b").select("a", "b").distinct()
            star = store(star, "star")
            found = store(_with_sets(star, held).mapInArrow(_edits(rule), EDITS), "edits")
            roots = joined(roots, found.where("kind = -1").select("a", "b"))
        few = still_open(rest if level == LEVELS else rest.where(F.col("size") <= FEW)).join(sketched, "row").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
        few = few.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = few.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "side", "row", "root", "n", F.substring("sketch", 1, 8 * SKETCH_WORDS).alias("sketch"))
        pairs = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "row").mapInArrow(_meet(rule), CLOSE)
        pairs = store(pairs.distinct(), "across")
        roots = roots if pairs.isEmpty() else _verify(_sketch_pairs(sketched, pairs.select("a", "b"), rule), held, rule, roots)
        if found is None:
            return roots
        members = found.where("kind >= 0").select(F.col("a").alias("key"), F.col("b").alias("row"), F.col("kind").alias("side"))
    return roots


def _components(docs: DataFrame, k: int, rule: Rule) -> DataFrame:
    """(row, doc_id, n_shingles, root) of ``docs`` (row, doc_id, text); root is null without links."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = docs.select("row", "doc_id", "text").mapInArrow(_sign(k, rule), ROWS)
    # documents go by their row, the rest by the signature or pair they are about
    spread = signed.repartition(parts, F.when(F.col("kind").isin(DOC, LEAST), F.col("b")).when(F.col("kind").isin(SIG, DIGEST), F.col("a")).otherwise(F.xxhash64("a", "b")))
    found = store(spread.sortWithinPartitions("kind", "a", "b").mapInArrow(_pair_up(rule), ROWS), "pairs")

    sketched = found.where((F.col("kind") == DOC) & (F.col("n") > 0)).select(F.col("b").alias("row"), "n", "sketch")
    # equal sets of different tasks: the first stands for all in pairs
    digests = found.where(F.col("kind") == DIGEST).select(F.col("a").alias("digest"), F.col("n").alias("more"), F.col("b").alias("row"))
    several = digests.groupBy("digest", "more").agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1")
    copies = store(digests.join(several, ["digest", "more"]).where("row != first").select("first", "row"), "copies")
    members = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("sig"), F.col("b").alias("row")).distinct().withColumn("band", F.col("sig").bitwiseAND(F.lit(63)))
    least = found.where(F.col("kind") == LEAST).select((F.col("a") % 64).alias("band"), F.col("b").alias("row"), F.col("n").alias("least"))
    # how many small groups of a band a row and any partner are in together, at least
    asks = least.join(members.groupBy("row", "band").count(), ["row", "band"], "left").withColumn("asks", F.col("least") - F.coalesce("count", F.lit(0)))
    asks = store(asks.where("asks > 0").select("row", "band", "asks"), "asks")
    met = found.where(F.col("kind") == PAIR).withColumn("band", F.col("n").bitwiseAND(F.lit(63)).cast("long"))
    pairs = met.groupBy("a", "b", "band").agg(F.sum(F.call_function("shiftright", "n", F.lit(6))).alias("met"))
    for c in ("a", "b"):
        pairs = pairs.join(asks.select(F.col("row").alias(c), "band", "asks"), [c, "band"], "left").where(F.col("met") >= F.coalesce("asks", F.lit(0))).drop("asks")
    for c in ("a", "b"):
        pairs = pairs.join(copies.select(F.col("row").alias(c), F.col("first").alias(f"f{c}")), c, "left")
    pairs = pairs.select(F.coalesce("fa", "a").alias("x"), F.coalesce("fb", "b").alias("y")).where("x != y")
    pairs = store(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "candidates")
    same = found.where(F.col("kind") == SAME).select("a", "b").unionByName(copies.select(F.col("first").alias("a"), F.col("row").alias("b")))
    close = _sketch_pairs(sketched, pairs, rule)
    roots = _verify(close, _sets(docs, _ends(close), k), rule, smallest_reachable(same))
    # an equal set's copies stay out: the first has the same signatures
    members = members.join(asks, ["row", "band"], "left_anti").join(copies, "row", "left_anti").select(F.col("sig").alias("key"), "row")
    roots = _across(docs, sketched, members, roots, k, rule)
    sizes = found.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("row"), F.col("n").cast("long").alias("n_shingles"))
    return sizes.join(roots.withColumnRenamed("node", "row"), "row", "left")


def jaccard_components(df: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reachable by links.

    ``k`` words a shingle; documents link when ``den * intersection >= num * union``.
    """
    with scratch(df.sparkSession):
        placed = store(_components(numbered(df, id_col, text_col), k, Rule(num, den)), "placed", keep=True)
    least = placed.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` of each component, all columns as they are: the smallest id's (nulls last), then
    the first in row order. Rows without links stay."""
    rows, number = stable(df, "input"), fresh(df, "row")
    with scratch(df.sparkSession):
        placed = store(_components(numbered(rows, id_col, text_col), k, Rule(num, den)), "placed", keep=True)
    first = placed.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    gone = store(placed.join(first, "root").where(F.col("row") != F.col("first.row")).select(F.col("row").alias(number)), "gone")
    # texts of rows that can't be gone aren't shuffled
    rows = rows.withColumn(number, F.monotonically_increasing_id())
    flag = fresh(rows, "maybe")
    rows = _flagged(rows, number, gone.select(F.col(number).alias("row")), flag)
    kept, some = rows.where(~F.col(flag)), rows.where(F.col(flag)).join(gone, number, "left_anti")
    return kept.select(*df.columns).union(some.select(*df.columns))
