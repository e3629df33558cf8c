"""Very long words, and very many spans in one text."""

import random
import time

from mnemograph.llm.pii import CHUNK, find_pii, mask_pii
from mnemograph.llm.quality import Buckets, _shape


def test_the_whole_word_has_its_shape():
    assert _shape("a" * 10_000 + "9") == "a0" and _shape("ab1" * 100) == "a0" * 100
    buckets = Buckets()
    long = "x" * 9_999
    ids = buckets([long + "y", long + "1", long + "-"])
    assert len({*ids[1].tolist()}) == 3  # what follows 64 characters counts


def test_known_words_are_bounded_by_bytes():
    buckets = Buckets(most=100_000)
    for i in range(50):
        buckets([f"{i}" + "z" * 9_000])
    assert buckets.held < 120_000 and len(buckets.known) < 15


def test_many_spans_of_one_text(spark):
    rng = random.Random(1)
    words, want, at = [], [], 0
    for i in range(3 * CHUNK + 17):
        word = f"user{i}@mail.example.com" if i % 3 else "+49 30 1234567"
        gap = "x" * rng.randint(1, 9) + " "
        want.append((at + len(gap), at + len(gap) + len(word)))
        words.append(gap + word + " ")
        at += len(words[-1])
    text = "".join(words) + "end"
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in find_pii(df).collect()}
    assert found == {1: want, 2: [], 3: []}
    expected = text
    for (a, b), i in reversed(list(zip(want, range(len(want))))):
        expected = expected[:a] + ("[EMAIL]" if i % 3 else "[PHONE]") + expected[b:]
    assert {r["doc_id"]: r["text"] for r in mask_pii(df).collect()} == {1: expected, 2: "none", 3: None}


def test_time_grows_with_the_spans(spark):
    took = []
    for n in (4_000, 16_000):
        df = spark.createDataFrame([(1, " ".join(f"a{i}@b.example.org" for i in range(n)))], "doc_id long, text string")
        find_pii(df).selectExpr("size(spans)").collect()
        began = time.time()
        assert find_pii(df).selectExpr("size(spans)").first()[0] == n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 2


def test_focus_saves_products_of_equal_lengths():
    """Vectors of one length, as the given ones are: half of the coordinates rule most candidates out."""
    import numpy as np

    from mnemograph.llm.topk import Best, search_bucket

    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None])
    lengths = np.linalg.norm(v, axis=1)
    order = np.argsort(-lengths, kind="stable")
    v, lengths, ids = v[order], lengths[order], np.arange(3000)
    q = slice(0, 3000, 60)
    best, done = Best(50, 5), 0
    for lo in range(0, 3000, 500):
        done += search_bucket(best, v[q], ids[q], lengths[q], v[lo : lo + 500], ids[lo : lo + 500], lengths[lo : lo + 500])
    scores = v[q] @ v.T
    scores[np.arange(50), np.arange(0, 3000, 60)] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert (best.id == want).all()
    assert done < 0.6 * scores.size
