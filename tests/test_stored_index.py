"""The stored index against scoring every node."""

import random

import pytest
from pyspark.sql import functions as F

from mnemograph.operators import index, stored_index

SCHEMA = "node_id long, text string, node_type string, ord long, bm25 double, term string"


def rows(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words[: 3 + i % 58]) for _ in range(rng.randint(0, 40)))
        # a word that only few neighbours have
        text += " rare rare" if 400 <= i < 405 else " solo" if i == 7 else ""
        out.append((seed * 10_000 + i, text if i % 50 else None, ("A", "b")[i % 2], 1, 2.0, "t"))
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    parts = [rows(900, 1), rows(300, 2) + rows(300, 2)[:5], rows(20, 3)]
    for part in parts:
        stored_index.append(spark.createDataFrame(part, SCHEMA), path)
    return path, spark.createDataFrame([r for p in parts for r in p], SCHEMA)


def whole(nodes, query, k, types=None):
    nodes = nodes.withColumn("text", F.coalesce("text", F.lit("")))
    # repeated ids are nodes of their own
    scored = index.bm25(nodes, query, node_types=types).withColumn("bm25", F.round("bm25", 6))
    return [tuple(r) for r in index.top(scored, k, "bm25").collect()]


@pytest.mark.parametrize("query,k,types", [("word1 word2 word2 rare", 10, None), ("rare", 20, None), ("word3", 7, ["B"]), ("word50 solo", 5, None), ("word1", 2000, None), ("the of", 5, None), ("absent", 5, None)])
def test_search_is_exact(spark, stored, query, k, types):
    path, nodes = stored
    got = [tuple(r) for r in stored_index.search(spark, path, query, k, types, digits=6).collect()]
    assert got == whole(nodes, query, k, types)


def test_ranges_out_of_reach_are_not_read(spark, stored):
    path, _ = stored
    # one range holds the rare word, so ranges with frequent words alone can't reach its score
    total, read = stored_index.Search(spark, path, "rare word1", 3).count()
    assert total > 3 >= read


def test_statistics_after_an_append_and_a_lost_one(spark, stored, tmp_path):
    path, nodes = stored
    want = {tuple(r) for r in index.postings(nodes.withColumn("node_id", F.monotonically_increasing_id()).withColumn("text", F.coalesce("text", F.lit("")))).groupBy("term").agg(F.count("*"), F.sum("tf")).collect()}
    assert {tuple(r) for r in stored_index.term_statistics(spark, path).collect()} == want
    # a segment whose statistics were never written is no part of the index, and its number is taken again
    own = str(tmp_path / "ix")
    stored_index.append(spark.createDataFrame(rows(30, 4), SCHEMA), own)
    before = stored_index.term_statistics(spark, own).count()
    spark.read.parquet(f"{own}/postings/segment=0").write.partitionBy("bucket").parquet(f"{own}/postings/segment=1")
    spark.read.parquet(f"{own}/nodes/segment=0").write.parquet(f"{own}/nodes/segment=1")
    assert stored_index.term_statistics(spark, own).count() == before
    one = [tuple(r) for r in stored_index.search(spark, own, "word1", 5, digits=6).collect()]
    assert one == whole(spark.createDataFrame(rows(30, 4), SCHEMA), "word1", 5)
    assert stored_index.append(spark.createDataFrame(rows(30, 5), SCHEMA), own) == 1
    assert [tuple(r) for r in stored_index.search(spark, own, "word1", 5, digits=6).collect()] == whole(spark.createDataFrame(rows(30, 4) + rows(30, 5), SCHEMA), "word1", 5)


def test_many_queries(spark, stored):
    path, nodes = stored
    asked = [(1, "word1 word2 word2"), (2, "rare solo"), (3, None), (4, "the"), (1, "word9")]
    got = stored_index.search_many(spark, path, spark.createDataFrame(asked, "query_id long, query string"), 6, digits=6)
    want = [(1, i + 1, *r) for i, r in enumerate(whole(nodes, "word1 word2 word2 word9", 6))] + [(2, i + 1, *r) for i, r in enumerate(whole(nodes, "rare solo", 6))]
    assert sorted(map(tuple, got.collect())) == want


def test_put_together_as_one_segment(spark, stored, tmp_path):
    path, nodes = stored
    target = str(tmp_path / "one")
    stored_index.compacted(spark, path, target)
    for query in ("word1 rare", "word40"):
        assert [tuple(r) for r in stored_index.search(spark, target, query, 9, digits=6).collect()] == whole(nodes, query, 9)
    assert stored_index.append(spark.createDataFrame(rows(10, 6), SCHEMA), target) == 1
    more = nodes.unionByName(spark.createDataFrame(rows(10, 6), SCHEMA))
    assert [tuple(r) for r in stored_index.search(spark, target, "word2", 9, digits=6).collect()] == whole(more, "word2", 9)


def test_empty_index(spark, tmp_path):
    assert stored_index.search(spark, str(tmp_path / "none"), "word1", 3).count() == 0
    stored_index.append(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert stored_index.search(spark, str(tmp_path / "e"), "word1", 3).count() == 0
    assert stored_index.term_statistics(spark, str(tmp_path / "e")).count() == 0
    assert stored_index.search_many(spark, str(tmp_path / "e"), spark.createDataFrame([(1, "word1")], "query_id long, query string"), 3).count() == 0
    stored_index.append(spark.createDataFrame(rows(10, 7), SCHEMA), str(tmp_path / "e"))
    assert stored_index.search(spark, str(tmp_path / "e"), "word1", 3).count() > 0


def test_an_append_moves_texts_not_words(spark, tmp_path):
    """A row for each word of a node was moved twice; now a node is, and a term's row in a range of nodes."""
    words = [f"word{i}" for i in range(149)]
    texts = [(i, " ".join(words[i % 50 : i % 50 + 100])) for i in range(600)]
    nodes = spark.createDataFrame([(i, t, "A", 1, 2.0, "t") for i, t in texts], SCHEMA)

    def moved():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = moved()
    stored_index.append(nodes, str(tmp_path))
    assert moved() - before < 6_000  # of 60,000 pairs of a node and a term
    assert {r["term"]: r["df"] for r in stored_index.term_statistics(spark, str(tmp_path)).collect()} == {w: sum(w in t.split() for _, t in texts) for w in words}
