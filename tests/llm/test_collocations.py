"""Phrase mining against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from mnemograph.llm.collocations import mine_phrases, subtree_counts

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, id long"


def plain(rows, top, least, depth=5):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    counts[lang or "und", tuple(w[i : i + m])] += 1
    wanted = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    dropped = {(lang, p[i : i + m]) for (lang, p), a in wanted.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 100 * counts[lang, p[i : i + m]]}
    found = {}
    for (lang, p), a in wanted.items():
        if (lang, p) not in dropped:
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, own in found.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["é", "知识", "A|b", "\x1cx", " "]
    out = []
    for i in range(150):
        text = "".join(rng.choice(words[: 4 + i % 31]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! "][: 3 + i % 7]) for _ in range(rng.randint(0, 80)))
        out.append((text, ("en", "de", None)[i % 3]))
    out += [("Of The One "  * 120, "en"), ("of the one of the", "en"), (None, "en"), ("", None), ("...", "fr"), ("x" * 5000 + " y", "fr"), ("a b " * 700, "de")]
    return out * 2


@pytest.mark.parametrize("budget,block_words,slice_bytes", [(500_000, 700_000, 1 << 20), (40, 90, 50), (7, 20_000, 64)])
def test_phrases(spark, budget, block_words, slice_bytes):
    own = rows()
    df = spark.createDataFrame([(i, *x, "p", 1, 2) for i, x in enumerate(own)], SCHEMA).repartition(3)
    got = mine_phrases(df, top=40, least=6, budget=budget, block_words=block_words, slice_bytes=slice_bytes)
    want = plain(own, 40, 6)
    assert sorted(map(tuple, got.collect())) == want
    assert {r[0] for r in want} == {"en", "de", "und"}


def test_nothing_to_find(spark):
    df = spark.createDataFrame([(1, "one two three", "en", "p", 1, 2), (2, None, None, None, None, None)], SCHEMA)
    assert mine_phrases(df).count() == 0
    assert mine_phrases(df.limit(0)).count() == 0


def test_counts_past_64_bits(spark):
    """The score is exact where 1000 * a * n passes 64 bits."""
    from pyspark.sql import functions as F

    a, n, l, r = 10**12 + 7, 10**13 + 9, 10**12 + 11, 3 * 10**12 + 1
    df = spark.range(1).select(F.lit(a).cast("decimal(19,0)").alias("a"), F.lit(n).cast("decimal(19,0)").alias("n"), F.lit(l).cast("decimal(19,0)").alias("l"), F.lit(r).cast("decimal(19,0)").alias("r"))
    assert df.select(F.expr("(a * n * cast(1000 as decimal(4,0))) div (l * r)")).first()[0] == 1000 * a * n // (l * r)


def test_leaves_of_a_subtree():
    words = np.array([[9, 9, 3, 9], [8, 8, 2, 8], [7, 0, 1, 7]], dtype=np.uint32)  # suffixes 9 8 7, 9 8, 3 2 1, 9 8 7
    got = {(tuple(p), a) for ps, ns in subtree_counts(words, np.array([2, 5, 1, 4]), 3, 3) for p, a in zip(ps.tolist(), ns.tolist(), strict=True)}
    # of hot words (3 or less) also what is below the least count, unless it has the whole depth
    assert got == {((9, 8), 11), ((9, 8, 7), 6), ((3, 2), 1)}
