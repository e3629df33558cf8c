"""Previews, even samples, ranges, subtitles, rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.functions.timeexpr import srt_time


def head(df: DataFrame, rows: int = 100) -> tuple[DataFrame, bool]:
    """The first rows (a preview's limit), and whether there are more."""
    return df.limit(rows), df.limit(rows + 1).count() > rows


def markdown(df: DataFrame, rows: int = 100) -> str:
    """A preview as a Markdown table under a line of its size."""
    shown, more = head(df, rows)
    got = shown.collect()
    text = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    top = f"{len(got)}{'+' if more else ''} rows, {len(df.columns)} columns"
    return "\n".join([top, "", line(df.columns), line(["---"] * len(df.columns)), *(line(map(text, r)) for r in got)])


def even_positions(length: Column, n: int) -> Column:
    """0-based places of ``n`` items spread evenly over ``length``; n below 1: all."""
    if n <= 0:
        return F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    if n == 1:
        return F.when(length > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (length - 1) / (n - 1)).cast("int")))
    return F.when(length > n, at).when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))


def compact(numbers: DataFrame, key: str, n: str) -> DataFrame:
    """(key, ranges): distinct numbers as "1-3, 5"."""
    w = Window.partitionBy(key).orderBy(n)
    runs = numbers.select(key, n).distinct().withColumn("g", F.col(n) - F.row_number().over(w)).groupBy(key, "g").agg(F.min(n).alias("a"), F.max(n).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    one = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("r"))
    return one.select(key, F.array_join(F.transform("r", lambda x: x["t"]), ", ").alias("ranges"))


def srt(cues: DataFrame, key: str, start: str, end: str, text: str) -> DataFrame:
    """(key, cue_no, cue) of cues by start, in seconds; a key's cues are numbered from 1."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(start, end, text))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return cues.withColumn("cue_no", n).select(key, "cue_no", F.concat_ws("\n", F.col("cue_no").cast("string"), F.concat_ws(" --> ", srt_time(ms(start)), srt_time(ms(end))), text).alias("cue"))


def _cue(no: Column, start: Column, end: Column, body: Column) -> Column:
    at = lambda c: srt_time((c * 1000).cast("long"))  # noqa: E731  (cut, not rounded)
    return F.concat_ws("\n", no.cast("string"), F.concat_ws(" --> ", at(start), at(end)), body)


def srt_segments(segments: DataFrame, key: str, order: str, start: str = "start", end: str = "end", text: str = "text", label: str | None = None) -> DataFrame:
    """(key, cue_no, cue) of segments in ``order``, an integer: a missing start is 0, a missing end or one of 0 the start,
    and ``label``, where there is one, stands before the text in brackets. A segment whose time is no number
    has no cue, but its number is used up."""
    from mnemograph.operators.rank import running_count

    number = lambda c: F.col(c).cast("string").try_cast("double")
    bad = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") & number(c).isNull()
    first = F.coalesce(number(start), F.lit(0.0))
    last = F.when(F.coalesce(number(end), F.lit(0.0)) == 0, first).otherwise(number(end))
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    if label:
        body = F.when(F.coalesce(F.col(label), F.lit("")) != "", F.concat(F.lit("["), F.col(label), F.lit("] "), body)).otherwise(body)
    numbered = running_count(segments, [key], order, F.lit(True), "cue_no")
    return numbered.where(~bad(start) & ~bad(end)).select(key, "cue_no", _cue(F.col("cue_no"), first, last, body).alias("cue"))


def srt_sentences(chunks: DataFrame, key: str, order: str, start: str = "start", end: str = "end", sentences: str = "sentences") -> DataFrame:
    """(key, cue_no, cue) of chunks of sentences in ``order``, an integer: a cue a sentence, with its chunk's time, numbered
    on over the chunks."""
    from mnemograph.operators.rank import running_sum

    n = F.coalesce(F.size(sentences), F.lit(0))
    upto = running_sum(chunks.where(n > 0), [key], order, n, "__upto")
    each = upto.select(key, start, end, (F.col("__upto") - n).alias("__before"), F.posexplode(sentences).alias("__i", "__s"))
    no = F.col("__before") + F.col("__i") + 1
    return each.select(key, no.alias("cue_no"), _cue(no, F.col(start), F.col(end), F.coalesce("__s", F.lit(""))).alias("cue"))


def write_ordered(cues: DataFrame, key: str, order: str, text: str, path: str) -> None:
    """A text file for each key under ``path``/key=value: its texts in order, a blank line after each.

    A key's rows meet in one partition and are sorted there, on disk where they are many; nothing is gathered.
    """
    lines = cues.select(F.col(key).alias(key), F.col(order).alias("__order"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("value"))
    lines.repartition(key).sortWithinPartitions(key, "__order").select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def write_packed(cues: DataFrame, key: str, order: str, text: str, path: str) -> DataFrame:
    """The texts of ``write_ordered`` as rows (path, value) of one table under ``path``, and that table read again.

    For many keys: a file each costs more than its text, at writing, listing and opening. A row is a file as a reader
    takes it, whole, and its path says key=value as the folder would.
    """
    line = F.struct(F.col(order).alias("o"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n\n")).alias("v"))
    whole = cues.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["v"]), "").alias("value"))
    return pack(whole.select(packed_path(key, F.col(key)), "value"), path)


def packed_path(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"/{key}="), F.coalesce(value.cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("/part")).alias("path")


def pack(files: DataFrame, path: str) -> DataFrame:
    """Small files, rows (path, value), written as one table under ``path`` and read again."""
    files.write.mode("overwrite").parquet(path)
    return files.sparkSession.read.parquet(path)


def violations(files: DataFrame, rules: dict[str, str], path: str = "path", text: str = "text") -> DataFrame:
    """(path, rule, n): how often each rule's pattern stands in a file; one pass over the texts."""
    counts = F.array(*(F.struct(F.lit(name).alias("rule"), F.regexp_count(F.col(text), F.lit(pattern)).alias("n")) for name, pattern in rules.items()))
    return files.select(path, F.explode(counts).alias("x")).select(path, "x.rule", "x.n").where("n > 0")


def verdicts(found: DataFrame, rules: list[str]) -> DataFrame:
    """(rule, n_files, n, passed) of every rule."""
    all_rules = found.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    agg = found.groupBy("rule").agg(F.count("*").alias("n_files"), F.sum("n").alias("n"))
    return F.broadcast(all_rules).join(agg, "rule", "left").fillna(0, ["n_files", "n"]).withColumn("passed", F.col("n") == 0)


def numbered_results(docs: DataFrame, order: str, link: str = "link", first: int = 1) -> DataFrame:
    """Results with a link, numbered on from ``first``; those without one are left out."""
    from mnemograph.operators.rank import global_rank

    return global_rank(docs.where(F.coalesce(F.col(link), F.lit("")) != ""), F.col(order), name="no").withColumn("no", F.col("no") + first)
