"""Alignment against whole texts, every token pair and every link."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mnemograph.llm.alignment import Aligner, align_tokens, highest, merge_counts, slices
from mnemograph.llm.token_counts import byte_symbols

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BACK = {c: i for i, c in enumerate(byte_symbols())}
ODD = ["a", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", " ", "　", "﻿", "᠎", "​", "é", "知", "'s", "<|endoftext|>", "<s>", "▁", "\x00", "\x1c", "!", "..", "9", "word", "The", "😀", ";\r", "<0x41>", "_", "².", "×."]


def tokens(text):
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw_a = [bytes(BACK[c] for c in A.id_to_token(i)) for i in a]
    raw_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return (list(zip(a, raw_a, strict=True)), list(zip(b, raw_b, strict=True))) if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode() else ([], [])


def spans(own):
    out, at = [], 0
    for i, raw in own:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(rows):
    each = []
    for doc_id, text in rows:
        a, b = map(spans, tokens(text) if text else ([], []))
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = [(",".join(str(i) for i, s, e in a if lo < e <= hi), ",".join(str(i) for i, s, e in b if lo < e <= hi)) for lo, hi in zip([0, *ends], ends)]
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        each.append((doc_id, len(a), len(b), groups, links))
    counts = Counter(x for *_, links in each for x in links)
    most = Counter()
    for (a, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (d, na, nb, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join("|".join(x) for x in g).encode()).hexdigest() if g else "")
        for d, na, nb, g, ls in each
    ]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v) for v in r))


@pytest.fixture(scope="module")
def aligner():
    return Aligner("byte_bpe_50k.json", "piece_bpe_32k.model", 100 << 20)


@pytest.mark.parametrize("settings", [{}, {"block_links": 40, "slice_chars": 30, "fan": 3, "cache_bytes": 40_000}])
def test_alignment(spark, docs, settings):
    rng = random.Random(8)
    more = ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 25))) for _ in range(150)] + ["word, " * 60 + "▁", "one\ntwo" * 30]
    extra = spark.createDataFrame([(1000 + i, t, None, None, 1, 2, 3) for i, t in enumerate(more)], docs.schema)
    df = docs.unionByName(extra)
    got = align_tokens(df, **settings)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert order(got.collect()) == order(want)
    assert any(r[1] == 0 and r[7] == "" for r in want) and any(r[5] < r[4] for r in want)


def test_empty_table(empty):
    assert align_tokens(empty).count() == 0


def test_parts_give_the_tokens_of_whole_texts(aligner):
    rng = random.Random(11)
    for _ in range(4000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(1, 16)))
        parts = [p for s in slices(text, 6) for p in aligner.parts(s)]
        aligner.learn(parts)
        numbers = aligner.of(parts)
        a, b = tokens(text)
        assert (not a) == (not aligner.bad.isdisjoint(numbers))
        if a:
            assert aligner.sums(np.array(numbers))[:2] == [len(a), len(b)]


def test_forgotten_parts_come_back(aligner):
    own = Aligner("byte_bpe_50k.json", "piece_bpe_32k.model", 30_000)
    text = " ".join(f"word{i % 70}, x{i}" for i in range(300))
    parts = own.parts(" " + text)
    aligner.learn(parts)
    want = [aligner.groups[i] for i in aligner.of(parts)]
    for _ in range(4):
        own.learn(parts)
        assert [own.groups[i] for i in own.of(parts)] == want
        own.forget()
        assert own.held < 200_000


def test_merge_and_highest():
    rng = np.random.default_rng(3)
    runs = []
    for _ in range(7):
        codes = np.unique(rng.integers(0, 1 << 20, 500) & ~0xFFF0)
        runs.append((codes, rng.integers(1, 9, len(codes))))
    codes, n = merge_counts(runs)
    want = Counter()
    for c, k in runs:
        want.update(dict(zip(c.tolist(), k.tolist())))
    assert dict(zip(codes.tolist(), n.tolist())) == want and (np.diff(codes) > 0).all()
    best = highest(codes, n)
    for b in np.unique(codes >> 16):
        own = codes >> 16 == b
        assert (best[own] == (n[own] == n[own].max())).all()
