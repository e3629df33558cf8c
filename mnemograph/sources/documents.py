"""Notebooks as blocks, diagrams as cells, media probes as streams and chapters."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mnemograph.functions.media import rate
from mnemograph.operators.rank import running_count

#: Kinds of images that a notebook's output may hold, the first that is there is shown (fixed values).
IMAGES = ("image/png", "image/jpeg", "image/gif")
#: Places that a cell takes among a notebook's blocks: more than outputs that it can hold.
OUTPUTS = 1_000_000


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _joined(v: Column, path: str) -> Column:
    """A text that is given whole or as a list of lines."""
    lines = F.try_variant_get(v, path, "array<string>")
    return F.coalesce(F.array_join(lines, ""), F.try_variant_get(v, path, "string"), F.lit(""))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def notebook_blocks(spark: SparkSession, path: str, most_images: int = 20, most_chars: int = 2000) -> DataFrame:
    """(path, block_no, kind, text) of notebooks: Markdown cells, code cells with their count, and outputs.

    A stream's text and a plain result are cut after ``most_chars``; an error is its name and value; of a result
    with an image only the image counts, as Base64. After ``most_images`` images of a file the rest are left out, and
    a last block says so. These limits are the preview's. A file that is no notebook has no blocks.
    """
    v = F.col("v")
    # a variant for each cell: one of the whole file has a limit of bytes
    book = F.from_json("value", "cells array<variant>, broken string", {"columnNameOfCorruptRecord": "broken"})
    books = _whole(spark, path).where(F.startswith(F.ltrim("value"), F.lit("{"))).select("path", book.alias("b")).where("b.broken is null")
    cells = books.select("path", F.posexplode("b.cells").alias("cell", "v")).withColumn("cell", F.col("cell").cast("long")).withColumn("type", F.try_variant_get(v, "$.cell_type", "string"))
    source = _stripped(_joined(v, "$.source"))
    count = F.coalesce(F.nullif(F.try_variant_get(v, "$.execution_count", "string"), F.lit("0")), F.lit(" "))
    code = F.concat(F.lit("In ["), count, F.lit("]:\n```python\n"), source, F.lit("\n```"))
    shown = cells.where(F.col("type").isin("markdown", "code")).select("path", "cell", F.lit(-1).alias("at"), F.lit("text").alias("kind"), F.when(source != "", F.when(F.col("type") == "code", code).otherwise(source)).alias("text"))

    o = F.col("o")
    outputs = cells.where("type = 'code'").select("path", "cell", F.posexplode(F.try_variant_get(v, "$.outputs", "array<variant>")).alias("at", "o")).withColumn("type", F.try_variant_get(o, "$.output_type", "string"))

    def cut(c: Column) -> Column:
        return F.when(F.length(c) > most_chars, F.concat(F.substring(c, 1, most_chars), F.lit("\n... (truncated)"))).otherwise(c)

    image = F.coalesce(*(F.when(F.try_variant_get(o, f"$.data['{m}']", "variant").isNotNull(), _joined(o, f"$.data['{m}']")) for m in IMAGES))
    streamed, plain = _stripped(_joined(o, "$.text")), _stripped(_joined(o, "$.data['text/plain']"))
    said = F.concat(F.lit("["), F.coalesce(F.try_variant_get(o, "$.name", "string"), F.lit("stdout")), F.lit("]\n"), cut(streamed))
    failed = F.concat(F.lit("[error] "), F.coalesce(F.try_variant_get(o, "$.ename", "string"), F.lit("Error")), F.lit(": "), F.coalesce(F.try_variant_get(o, "$.evalue", "string"), F.lit("")))
    is_image = ~F.coalesce(F.col("type").isin("stream", "error"), F.lit(False)) & image.isNotNull()
    text = F.when(F.col("type") == "stream", F.when(streamed != "", said)).when(F.col("type") == "error", failed).when(image.isNotNull(), image).when(plain != "", F.concat(F.lit("Out: "), cut(plain)))
    outputs = outputs.select("path", "cell", "at", F.when(is_image, "image").otherwise("text").alias("kind"), text.alias("text"))

    both = shown.unionByName(outputs).where("text is not null").withColumn("place", F.col("cell") * OUTPUTS + F.col("at") + 1)
    both = running_count(both, ["path"], "place", F.col("kind") == "image", "image_no", 1000 * OUTPUTS)
    kept = both.where((F.col("kind") == "text") | (F.col("image_no") <= most_images)).select("path", "place", "kind", "text")
    more = both.groupBy("path").agg(F.max(F.when(F.col("kind") == "image", F.col("image_no"))).alias("n"), F.max("place").alias("last")).where(F.col("n") > most_images)
    kept = kept.unionByName(more.select("path", (F.col("last") + 1).alias("place"), F.lit("text").alias("kind"), F.lit(f"... (image outputs capped at {most_images}; raise max_pages for more)").alias("text")))
    return running_count(kept, ["path"], "place", F.lit(True), "no", 1000 * OUTPUTS).select("path", (F.col("no") - 1).alias("block_no"), "kind", "text")


@F.pandas_udf(StringType())
def inflated(texts: pd.Series) -> pd.Series:
    """Base64 of a raw deflate stream as text; null where it is none."""

    def one(text: str | None) -> str | None:
        try:
            return zlib.decompress(base64.b64decode(text), -zlib.MAX_WBITS).decode()
        except (ValueError, TypeError, zlib.error):
            return None

    return texts.map(one)


ATTRIBUTES = r'(?:\s+[\w:.-]+="[^"]*")*\s*'


def _unescaped(c: Column) -> Column:
    """XML text with its named entities, and line ends, as characters."""
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(mark))
    return c


def drawing_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, cell, id, label, style, is_edge, x, y, width, height) of drawings: cells with a geometry.

    A page's model stands as XML inside it, URL-encoded, or deflated in Base64; the first that gives one counts. Numbers
    that are left out are 0. A page that gives no model has no cells.
    """
    pages = _whole(spark, path).select("path", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<diagram[^>]*>(.*?)</diagram>"), F.lit(1))).alias("page", "text"))
    inline = F.col("text").rlike(r"^\s*<")
    text = _stripped(F.when(inline, F.col("text")).otherwise(_unescaped(F.col("text"))))
    bare = F.regexp_replace("text", r"\s", "")
    inner = F.coalesce(F.when(text.startswith("<"), text), inflated(bare), F.when(bare.startswith("%3C"), F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B"))))
    models = pages.select("path", "page", inner.alias("xml")).where(F.col("xml").startswith("<mxGraphModel"))
    # a cell is an element with or without content; only those with a geometry of their own are shown
    cells = F.regexp_extract_all("xml", F.lit(rf"(?s)<mxCell{ATTRIBUTES}(?:/>|>.*?</mxCell>)"), F.lit(0))
    found = models.select("path", "page", F.posexplode(cells).alias("cell", "c")).where(F.contains("c", F.lit("<mxGeometry")))
    head, geometry = (F.regexp_extract("c", rf"<{x}{ATTRIBUTES}", 0) for x in ("mxCell", "mxGeometry"))
    of = lambda name, where: _unescaped(F.regexp_extract(where, rf'\s{name}="([^"]*)"', 1))
    number = lambda name: F.coalesce(of(name, geometry).try_cast("double"), F.lit(0.0)).alias(name)
    return found.select("path", "page", "cell", of("id", head).alias("id"), of("value", head).alias("label"), of("style", head).alias("style"), (of("edge", head) == "1").alias("is_edge"), *(number(n) for n in ("x", "y", "width", "height")))


PROBE = (
    "format struct<duration:string,bit_rate:string,size:string,format_name:string>, "
    "streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,channels:int,sample_rate:string,bit_rate:string,"
    "side_data_list:array<struct<rotation:string>>,tags:map<string,string>,disposition:map<string,int>>>, "
    "chapters array<struct<start_time:string,end_time:string,tags:map<string,string>>>"
)


def probe_tables(probes: DataFrame, text: str = "text") -> dict[str, DataFrame]:
    """Media probes (key columns, JSON ``text``) as tables: ``formats``, ``streams`` and ``chapters`` with the key columns.

    A stream's rotation is its first side data's, else its tag's; flags are the dispositions that are set.
    """
    keys = [c for c in probes.columns if c != text]
    j = probes.select(*keys, F.from_json(text, PROBE).alias("j"))
    number = lambda c: F.col(c).try_cast("double")
    formats = j.select(*keys, F.col("j.format.format_name").alias("format"), number("j.format.duration").alias("duration"), number("j.format.bit_rate").alias("bit_rate"), number("j.format.size").alias("size"))
    s = j.select(*keys, F.posexplode("j.streams").alias("pos", "s"))
    turned = F.try_element_at(F.filter("s.side_data_list", lambda d: d["rotation"].isNotNull()), F.lit(1))["rotation"]
    rotation = F.coalesce(turned, F.nullif(F.try_element_at("s.tags", F.lit("rotate")), F.lit(""))).try_cast("double").cast("int")
    flags = F.coalesce(F.array_sort(F.map_keys(F.map_filter("s.disposition", lambda _, on: on == 1))), F.array().cast("array<string>"))
    streams = s.select(*keys, F.coalesce("s.index", "pos").alias("index"), *(F.col(f"s.{c}").alias(c) for c in ("codec_type", "codec_name", "width", "height", "channels")), rate(F.col("s.avg_frame_rate")).alias("rate"), rotation.alias("rotation"), F.try_element_at("s.tags", F.lit("language")).alias("language"), flags.alias("flags"))
    c = j.select(*keys, F.posexplode("j.chapters").alias("chapter", "c"))
    chapters = c.select(*keys, "chapter", number("c.start_time").alias("start"), number("c.end_time").alias("end"), F.try_element_at("c.tags", F.lit("title")).alias("title"))
    return {"formats": formats, "streams": streams, "chapters": chapters}
