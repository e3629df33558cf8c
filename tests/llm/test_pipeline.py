"""The pipeline's stages, one after another, against the operators' brute forces."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from test_operators import brute_hits, components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        if name != "packing":
            assert after.columns == docs.columns
        before, kept = docs.select("doc_id", "text").collect(), after.collect()
        if name == "near_duplicates":
            want = components([tuple(r) for r in before], 5, 80, 100)
            assert sorted(r["doc_id"] for r in kept) == sorted(d for d, n, c in want if c == d or not n)
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert sorted(r["doc_id"] for r in kept) == sorted(w[0] for w in brute_hits([tuple(r) for r in before], items) if not w[5])
        if name == "pii":
            assert after.count() == docs.count() and not after.where(F.col("n_chars") != F.length("text")).count()
        seen[name] = len(kept)
        docs = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    assert corpus_pipeline.run(spark, SF).count() == seen["packing"] > 0
