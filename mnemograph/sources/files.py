"""Tabular, subtitle, notebook, map, configuration and code files as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

RENDERERS = {
    "table": ("csv", "tsv", "xlsx", "xls"), "geo": ("geojson", "kml", "shp"), "notebook": ("ipynb",), "subtitle": ("srt", "vtt"), "pdf": ("pdf",), "drawio": ("drawio",),
    "image": ("png", "jpg", "jpeg", "gif", "webp", "bmp"), "video": ("mp4", "mov", "mkv", "webm", "avi"),
}


def renderer(path: Column) -> Column:
    """The kind of reader that a path's extension asks for; text for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("text")
    for kind, exts in RENDERERS.items():
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return out


def _whole(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, value) of whole files: those under ``path``, or rows of a table that holds many small ones."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value") if isinstance(path, str) else path
    return files.select("path", F.regexp_replace("value", r"\r\n?", "\n").alias("value"))


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header and the types that its values show; a quote in quotes is written twice.

    ``multi_line``: quoted values may hold line ends; such files can't be split, so a file is one task's.
    """
    return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"', multiLine=multi_line)


def read_srt(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, cue, time, text): blocks between blank lines; the line with an arrow is the time."""
    lines = _whole(spark, path).select("path", F.posexplode(F.split(F.trim("value"), r"\n\s*\n")).alias("cue", "block")).withColumn("l", F.transform(F.split("block", "\n"), lambda x: F.trim(x)))
    at = F.array_position(F.transform("l", lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
    found = lines.withColumn("at", at).where("at > 0")
    words = F.filter(F.slice("l", F.col("at") + 1, F.size("l")), lambda x: x != "")
    return found.select("path", "cue", F.element_at("l", F.col("at")).alias("time"), F.array_join(words, " ").alias("text"))


def read_vtt(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, cue, time, text): a time line, then lines up to a blank one."""
    cues = F.regexp_extract_all("value", F.lit(r"(?m)^[^\n]*-->[^\n]*(?:\n(?!\s*$)[^\n]+)*"), F.lit(0))
    got = _whole(spark, path).select("path", F.posexplode(cues).alias("cue", "block")).withColumn("l", F.split("block", "\n"))
    return got.select("path", "cue", F.trim(F.col("l")[0]).alias("time"), F.array_join(F.transform(F.slice("l", 2, F.size("l")), lambda x: F.trim(x)), " ").alias("text"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, geometry_type, geometry, properties): a row for each feature; both as JSON text."""
    kind = "features array<struct<geometry:string,properties:string>>"
    got = _whole(spark, path).select("path", F.posexplode(F.from_json("value", kind)["features"]).alias("i", "f"))
    return got.select("path", "i", F.get_json_object("f.geometry", "$.type").alias("geometry_type"), F.col("f.geometry").alias("geometry"), F.from_json("f.properties", "map<string,string>").alias("properties"))


def read_notebook(spark: SparkSession, path: str) -> DataFrame:
    """(path, cell, cell_type, source, outputs): sources as one text, outputs as JSON texts."""
    text = lambda c: F.coalesce(F.array_join(F.from_json(c, "array<string>"), ""), F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x"))
    kind = "cells array<struct<cell_type:string,source:string,outputs:array<string>>>"
    got = _whole(spark, path).select("path", F.posexplode(F.from_json("value", kind)["cells"]).alias("cell", "c"))
    source = F.when(F.col("c.source").startswith("["), text(F.col("c.source"))).otherwise(F.col("c.source"))
    return got.select("path", "cell", "c.cell_type", source.alias("source"), F.coalesce("c.outputs", F.array().cast("array<string>")).alias("outputs"))


def notebook_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("path").agg(F.count_if(F.col("cell_type") == "code").alias("n_code"), F.count_if(F.col("cell_type") == "markdown").alias("n_markdown"))


#: Languages by extension (fixed values); others have none.
LANGUAGES = {
    "css": "css", "js": "javascript", "ts": "typescript", "jsx": "jsx", "tsx": "tsx", "py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
    "rb": "ruby", "php": "php", "sh": "bash", "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "sql": "sql", "md": "markdown", "toml": "toml", "ini": "ini", "lua": "lua", "swift": "swift",
    "kt": "kotlin", "scala": "scala", "r": "r", "dart": "dart", "tex": "latex",
}


def language(path: Column) -> Column:
    """The language that a path's extension names; '' for others."""
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit(""))


def read_code(spark: SparkSession, path: str | DataFrame, lines: int = 500, name: Column | None = None) -> DataFrame:
    """(path, language, n_lines, text, truncated): the first lines of each file (a preview's limit); ``name`` is the
    path that the language is taken from. A last line end makes no line of its own."""
    got = _whole(spark, path).withColumn("l", F.split(F.regexp_replace("value", r"\n\z", ""), "\n"))
    n = F.when(F.col("value") == "", 0).otherwise(F.size("l"))
    return got.select("path", language(F.col("path") if name is None else name).alias("language"), n.alias("n_lines"), F.array_join(F.slice("l", 1, lines), "\n").alias("text"), (n > lines).alias("truncated"))


def read_dotenv(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value): NAME=value lines, with export and quotes taken off; the last one of a name."""
    shape = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    lines = _whole(spark, path).select("path", F.posexplode(F.split("value", "\n")).alias("i", "line")).where(F.col("line").rlike(shape) & ~F.col("line").rlike(r"^\s*#"))
    raw = F.regexp_extract("line", shape, 2)
    value = F.when(raw.rlike(r"^(['\"]).*\1$"), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(F.regexp_replace(raw, r"\s+#.*$", ""))
    return lines.select("path", "i", F.regexp_extract("line", shape, 1).alias("key"), value.alias("value")).groupBy("path", "key").agg(F.max_by("value", "i").alias("value"))


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): the sound JSON lines of session logs; broken ones are left out but numbered.

    Files are read by line and split: a line's number is its place in its block plus the lines of the file's
    earlier blocks, which one row a block holds.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    placed = lines.join(blocks, ["path", "block"]).select("path", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "line")
    return placed.where(F.try_parse_json("line").isNotNull() & F.startswith(F.ltrim("line"), F.lit("{")))


def probe(text: Column) -> Column:
    """struct<duration, bit_rate, width, height, frame_rate> of a media probe's JSON."""
    kind = "format struct<duration:string,bit_rate:string,size:string>, streams array<struct<codec_type:string,width:int,height:int,avg_frame_rate:string>>"
    j = F.from_json(text, kind)
    video = F.filter(j["streams"], lambda s: s["codec_type"] == "video")
    v = F.try_element_at(video, F.lit(1))
    return F.struct(j["format"]["duration"].try_cast("double").alias("duration"), j["format"]["bit_rate"].try_cast("double").alias("bit_rate"), v["width"].alias("width"), v["height"].alias("height"), v["avg_frame_rate"].alias("frame_rate"))


#: Folders of assets, the extensions that belong in each, and what they are (fixed values).
ASSETS = {
    "fonts": ("font", ("ttf", "otf", "woff2", "woff")), "sfx": ("audio", ("mp3", "wav", "m4a", "ogg")), "bgm": ("audio", ("mp3", "wav", "m4a", "ogg")),
    "images": ("image", ("png", "jpg", "jpeg", "webp", "svg")), "clips": ("video", ("mp4", "mov", "webm")),
}


def _relative(path: Column, root: str) -> Column:
    """Path below ``root``, whatever the scheme says."""
    return F.regexp_extract(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), rf"{re.escape(root.rstrip('/').split('://')[-1].lstrip('/'))}/(.*)$", 1)


def scan_assets(spark: SparkSession, root: str, file: Column | None = None, hashed: bool = False) -> DataFrame:
    """(file, bucket, kind, name, ext, size_kb, note, content_key) of the assets under ``root``: files in a bucket's folder
    with one of its extensions. ``note`` is what stands in a text file of the same name beside it (400 characters).

    Only notes are read; with ``hashed`` the contents too, and then ``content_key`` is of the content, else of path,
    time and size. ``file`` takes a file's name below ``root`` from ``path``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.withColumn("file", _relative(F.col("path"), root) if file is None else file).where("file <> ''")
    bucket, ext = F.element_at(F.split("file", "/"), 1), F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    stem = F.regexp_replace("file", r"\.[A-Za-z0-9]+$", "")
    key = F.substring(F.sha1("content"), 1, 16) if hashed else cache_key(F.col("path"), F.col("modificationTime").cast("double"), F.col("length"))
    listed = files.select("file", bucket.alias("bucket"), ext.alias("ext"), stem.alias("stem"), F.round(F.col("length") / 1024, 1).alias("size_kb"), key.alias("content_key"))
    known = F.lit(None).cast("string")
    for b, (kind, exts) in ASSETS.items():
        known = F.when((F.col("bucket") == b) & F.col("ext").isin(*exts), F.lit(kind)).otherwise(known)
    notes = files.where(F.endswith(F.col("file"), F.lit(".txt"))).select(stem.alias("stem"), F.substring(F.regexp_replace(F.decode("content", "UTF-8"), r"(?U)^\s+|\s+$", ""), 1, 400).alias("note"))
    assets = listed.withColumn("kind", known).where("kind is not null").join(notes, "stem", "left")
    return assets.select("file", "bucket", "kind", F.element_at(F.split("stem", "/"), -1).alias("name"), "ext", "size_kb", F.coalesce("note", F.lit("")).alias("note"), "content_key")


def manifest_changes(scanned: DataFrame, prior: DataFrame) -> DataFrame:
    """``scanned`` against the ``prior`` manifest (file, content_key, ..): ``state`` is new, changed, kept or gone.

    What a scan sees is taken from the scan. Columns that only the prior manifest has were added by hand and are kept;
    ``duration``, which a probe gives, is kept only where the content is the same, so null says that it is to be probed.
    Files that are gone keep their prior row. Of a file's several prior rows the largest counts.
    """
    by_hand = [c for c in prior.columns if c not in scanned.columns]
    one = prior.groupBy("file").agg(F.max(F.struct("content_key", *[c for c in prior.columns if c not in ("file", "content_key")])).alias("old"))
    both = scanned.withColumn("__there", F.lit(True)).join(one, "file", "full_outer")
    same = F.col("content_key") == F.col("old.content_key")
    state = F.when(F.col("old").isNull(), "new").when(F.col("__there").isNull(), "gone").when(same, "kept").otherwise("changed")
    shown = [F.when(F.col("__there").isNull(), F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) if c in prior.columns else F.col(c) for c in scanned.columns if c != "file"]
    kept = [(F.when(same | F.col("__there").isNull(), F.col(f"old.{c}")) if c == "duration" else F.col(f"old.{c}")).alias(c) for c in by_hand]
    return both.select("file", *shown, *kept, state.alias("state"))


def cache_key(path: Column, mtime: Column, size: Column, *more: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.concat_ws(":", path, mtime, size), *more)), 1, 16)


def numeric_split(features: DataFrame, geometry: str = "geometry") -> tuple[str | None, DataFrame, DataFrame]:
    """The first numeric column besides the geometry, and the rows that have a value there and that don't;
    all rows are without one where no column is numeric."""
    names = [f.name for f in features.schema if f.name != geometry and isinstance(f.dataType, NumericType)]
    if not names:
        return None, features.where(F.lit(False)), features
    there = F.col(f"`{names[0]}`").isNotNull()
    return names[0], features.where(there), features.where(~there)
