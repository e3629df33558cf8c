"""What the Jaccard join looks at and moves: long texts that share a passage, texts that stay."""

import numpy as np
import pytest

from mnemograph.llm import jaccard_join
from mnemograph.llm.jaccard_join import Rule, doc_sketch, fold, jaccard_components, keep_one, long_distance, segment_sketches


def own_words(rng, n):
    return [f"{x:08x}" for x in rng.integers(0, 1 << 32, n)]


def test_long_texts_with_a_passage(spark, monkeypatch):
    """Long unlike texts with a common passage are no pairs to look at; their near copies are found."""
    counts, plain = [], jaccard_join.store

    def counting(df, label, keep=False):
        out = plain(df, label, keep)
        if label == "candidates":
            counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "store", counting)
    rng, rows, want = np.random.default_rng(4), [], {}
    for _ in range(3):  # fewer holders of a signature than are noted as a large group
        passage = own_words(rng, 200)
        for _ in range(9):
            rows.append((len(rows), own_words(rng, 5000) + passage))
            want[len(rows) - 1] = len(rows) - 1
    for i in (0, 10, 26):
        near = list(rows[i][1])
        for at in rng.choice(5000, 60, replace=False):
            near[at] = "changed"
        rows.append((len(rows), near))
        want[len(rows) - 1] = i
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(df, 5, 80, 100).collect()} == want
    assert sum(counts) <= 2 * 3


def test_long_sketches():
    """Sets of more shingles than a short sketch has bits: unlike ones are too far apart, near ones aren't."""
    rng, rule = np.random.default_rng(5), Rule(80, 100)
    sets = [np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2)) for _ in range(2)]
    sets.append(np.unique(np.concatenate([sets[0][:5900], sets[1][:100]])))
    for words in (32, 64, 128):
        assert np.array_equal(fold(segment_sketches(sets[0], 4 * words), words), segment_sketches(sets[0], words))
    a, b, near = map(doc_sketch, sets)
    most = rule.difference(len(sets[0]), len(sets[1]))
    assert long_distance(a, b) > most
    assert long_distance(a, near) <= len(np.setxor1d(sets[0], sets[2])) <= most
    assert doc_sketch(sets[0][:2048]) == segment_sketches(sets[0][:2048], jaccard_join.SKETCH_WORDS).tobytes()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_that_stay_are_not_shuffled(spark, no_broadcast, tmp_path):
    def shuffled():
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rng = np.random.default_rng(6)
    texts = [" ".join(own_words(rng, 300)) for _ in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:5])], "doc_id long, text string").write.parquet(path)
    kept = keep_one(spark.read.parquet(path))
    before = shuffled()
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(400))
    assert 0 < shuffled() - before < sum(map(len, texts)) / 10
