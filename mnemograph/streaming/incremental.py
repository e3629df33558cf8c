"""Work on new items only: a file stream without repeats, drained when asked, and a worker that follows a first phase."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.session import checkpointed


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def marked(spark: SparkSession, path: str) -> bool:
    """Whether the marker file is there."""
    fs, target = _file(spark, path)
    return fs.exists(target)


def mark(spark: SparkSession, path: str) -> None:
    fs, target = _file(spark, path)
    fs.create(target, True).close()


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """What batches have written, with their ``run`` and ``batch``; None before the first row."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _work_on(batch: DataFrame, key: str, target: str, run: str, number: int, work: Callable[[DataFrame], DataFrame] | None) -> None:
    """Append the work of the batch's keys that the target lacks. A batch writes to its own folder, which one that is
    retried replaces; keys that it wrote before don't count as done."""
    spark = batch.sparkSession
    new, done = batch.where(F.col(key).cast("string") != "").dropDuplicates([key]), _written(spark, target)
    if done is not None:
        new = new.join(done.where(~((F.col("run").cast("string") == run) & (F.col("batch") == number))).select(key), key, "left_anti")
    out = work(new) if work else new
    if "error" in out.columns:
        out = checkpointed(out)  # two tables of one run of the work
        out.where("error is not null").select(*new.columns, "error").write.mode("overwrite").parquet(f"{target}-failed/run={run}/batch={number}")
        out = out.where("error is null").drop("error")
    out.write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")


def process_new(spark: SparkSession, source: str, schema: str, key: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None, files_a_batch: int = 100, format: str = "parquet") -> None:
    """Take the files under ``source`` that haven't been seen and append ``work`` of their new keys to ``target``.

    The checkpoint remembers the files and the target the keys, so no state grows with the stream: a key that comes
    again is left out by an anti join with the target, also after the checkpoint was lost. Rows without a key are
    left out. Where the work gives a column ``error``, rows that have one go to ``target``-failed.
    """
    stream = spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_a_batch).load(source)

    def write(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        _work_on(batch, key, target, run, number, work)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def retry_failed(spark: SparkSession, key: str, target: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Work again on failed items that the target still lacks; the number of those tried."""
    failed, done = _written(spark, f"{target}-failed"), _written(spark, target)
    if failed is None:
        return 0
    if done is not None:
        failed = failed.join(done.select(key), key, "left_anti")
    items = checkpointed(failed.drop("run", "batch", "error").dropDuplicates([key]))
    n = items.count()
    if n:
        _work_on(items, key, target, "retry", time.time_ns() // 1000, work)
    return n


def run_worker(
    spark: SparkSession, source: str, schema: str, key: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], first_done: str, own_done: str,
    alive: Callable[[], bool] | None = None, poll_seconds: float = 2.0, format: str = "parquet",
) -> dict[str, int]:
    """The second phase beside a first one that is still writing ``source``: the number of keys done and failed.

    It drains what is new and waits, until the first phase's marker ``first_done`` is there; then it drains once more and
    sets its own marker ``own_done``. If the first phase is no longer ``alive`` and has left no marker, what it wrote is
    still worked on, but there is no marker of ours and RuntimeError is raised. A worker that starts again goes on
    where the last one ended, items that failed first.
    """
    drain = lambda: process_new(spark, source, schema, key, target, checkpoint, work, format=format)
    retry_failed(spark, key, target, work)
    lost = False
    while True:
        # in this order: a marker or an end seen before the drain means that the drain took all
        ended, lost = marked(spark, first_done), alive is not None and not alive()
        if lost and not ended:
            ended = marked(spark, first_done)  # set between the two looks
        drain()
        if ended or lost:
            break
        time.sleep(poll_seconds)
    if not ended:
        raise RuntimeError(f"the first phase ended without {first_done}")
    done, failed = _written(spark, target), _written(spark, f"{target}-failed")
    n_done = 0 if done is None else done.select(key).distinct().count()
    if failed is not None and done is not None:
        failed = failed.join(done.select(key), key, "left_anti")
    n_failed = 0 if failed is None else failed.select(key).distinct().count()
    mark(spark, own_done)
    return {"done": n_done, "failed": n_failed}


def missing(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key isn't done yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def windowed_counts(stream: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts a window and key of a stream, rows later than ``late`` left out by the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")
