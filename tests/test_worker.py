"""The worker beside a first phase: restart, end marker, failed first phase, failed items."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from mnemograph.streaming.incremental import mark, process_new, run_worker, windowed_counts

KIND = "macro_id string, n long"


def put(spark, path, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def work(df):
    """Every item but those with n < 0."""
    return df.withColumn("double", F.col("n") * 2).withColumn("error", F.when(F.col("n") < 0, "negative"))


def values(spark, path):
    return sorted((r["macro_id"], r["double"]) for r in spark.read.parquet(path).collect())


def test_follows_the_first_phase_to_its_end(spark, tmp_path):
    source, target, p1, p2 = (str(tmp_path / x) for x in ("in", "out", "01_done", "02_done"))
    put(spark, source, [("m0", 1), ("m1", 2), ("", 7), (None, 8)])

    def first_phase():
        time.sleep(1)
        put(spark, source, [("m1", 99), ("m2", 3)])  # m1 comes again
        time.sleep(1)
        put(spark, source, [("m3", -1)])
        mark(spark, p1)

    writer = threading.Thread(target=first_phase)
    writer.start()
    counts = run_worker(spark, source, KIND, "macro_id", target, str(tmp_path / "cp"), work, p1, p2, alive=writer.is_alive, poll_seconds=0.2)
    writer.join()
    assert counts == {"done": 3, "failed": 1} and os.path.exists(p2)
    assert values(spark, target) == [("m0", 2), ("m1", 4), ("m2", 6)]


def test_starts_again(spark, tmp_path):
    source, target, p1, p2 = (str(tmp_path / x) for x in ("in", "out", "01_done", "02_done"))
    put(spark, source, [("m0", 1), ("m1", -5)])
    # the first run is lost in its work
    with pytest.raises(Exception, match="lost|raise_error|USER_RAISED"):
        process_new(spark, source, KIND, "macro_id", target, str(tmp_path / "cp"), lambda df: df.select("macro_id", "n", F.raise_error(F.lit("lost")).cast("long").alias("double")))
    process_new(spark, source, KIND, "macro_id", target, str(tmp_path / "cp"), work)
    assert values(spark, target) == [("m0", 2)]
    put(spark, source, [("m0", 50), ("m2", 3)])
    mark(spark, p1)
    # now the failed item can be done; the checkpoint is lost too, but the target knows its keys
    counts = run_worker(spark, source, KIND, "macro_id", target, str(tmp_path / "cp2"), lambda df: df.withColumn("double", F.col("n") * 2), p1, p2)
    assert counts == {"done": 3, "failed": 0}
    assert values(spark, target) == [("m0", 2), ("m1", -10), ("m2", 6)]
    assert run_worker(spark, source, KIND, "macro_id", target, str(tmp_path / "cp2"), work, p1, p2)["done"] == 3


def test_first_phase_that_failed(spark, tmp_path):
    source, target, p1, p2 = (str(tmp_path / x) for x in ("in", "out", "01_done", "02_done"))
    put(spark, source, [("m0", 1)])
    with pytest.raises(RuntimeError, match="without"):
        run_worker(spark, source, KIND, "macro_id", target, str(tmp_path / "cp"), work, p1, p2, alive=lambda: False)
    # what it wrote is done, but there is no marker
    assert values(spark, target) == [("m0", 2)] and not os.path.exists(p2)


def test_counts_in_windows(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "a"), ("2024-01-01 10:55:00", "a"), ("2024-01-01 11:00:00", "b")]
    spark.createDataFrame(rows, "at string, k string").select(F.col("at").cast("timestamp").alias("at"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, k string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "at", "k").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["n"]) for r in spark.table("windowed").collect()) == [("a", 2), ("b", 1)]
