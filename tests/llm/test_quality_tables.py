"""The quality classifier on the given tables: labelled rows that it didn't learn from."""

import os

import numpy as np
import pytest

from mnemograph.llm.quality import score_quality

SF = os.environ.get("MNEMOGRAPH_QUALITY_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").select("score", "predicted", "quality").toPandas()
    assert len(rows) > 50 and set(rows["quality"]) == {0, 1}
    good, bad = (rows["score"][rows["quality"] == y].to_numpy() for y in (1, 0))
    auc = np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad))
    assert auc > 0.98
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95
    assert abs(rows["score"].mean() - rows["quality"].mean()) < 0.05
