"""Graph-memory files: current and legacy layouts, subgraphs, embedding nodes."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemograph import schema
from mnemograph.functions.timeexpr import parse_item

INDEX = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("node", pa.string()), ("vector", pa.list_(pa.float32())), ("error", pa.string())])


def _named(entity: Column) -> tuple[Column, Column, Column]:
    """Of an entity that is a text or an object in JSON: its name, its type, itself as an object in JSON."""
    whole = F.startswith(entity, F.lit("{"))
    name = F.when(whole, F.get_json_object(entity, "$.name")).otherwise(entity)
    return name, F.when(whole, F.get_json_object(entity, "$.type")), F.when(whole, entity).otherwise(F.to_json(F.struct(name.alias("name"))))


def _from_legacy(old: Column) -> Column:
    """A memory of the older layout as one of the current: events, entities and screen texts come from the macro's
    parallel lists, by place; a list that is too short gives an empty description or the type ``unknown``."""
    none = F.lit(None)
    items = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    wrapped = lambda c: F.transform(items(c), lambda e: _named(e)[2])

    def macro(m: Column) -> Column:
        ids, told, kinds = items(m["subevent_ids"]), items(m["event_summaries"]), items(m["key_entity_types"])
        names = F.when(F.size(items(m["key_entity_names"])) > 0, m["key_entity_names"]).otherwise(F.transform(items(m["key_entities"]), lambda e: _named(e)[0]))

        def event(i: Column, j: Column) -> Column:
            said = F.coalesce(F.get(told, j), F.lit(""))
            action = F.when(said != "", F.substring(said, 1, 80)).otherwise(i)
            return F.struct(i.alias("event_id"), F.lit("action").alias("event_type"), m["time_range"].alias("time_range"), F.lit("").alias("subject"), F.lit("").alias("object"), action.alias("action"), said.alias("description"), m["node_id"].alias("macro_id"))

        def entity(name: Column, j: Column) -> Column:
            kind = F.when(j < F.size(kinds), F.get(kinds, j)).otherwise(F.lit("unknown"))
            return F.struct(F.format_string("ent_%03d", j + 1).alias("entity_id"), name.alias("name"), kind.alias("entity_type"), none.cast("map<string,string>").alias("attributes"), name.alias("description"), m["node_id"].alias("macro_id"))

        def screen(x: Column, j: Column) -> Column:
            return F.struct(F.format_string("ocr_%03d", j + 1).alias("text_id"), x.alias("text"), m["time_range"].alias("time_range"), x.alias("description"), m["node_id"].alias("macro_id"))

        graph = F.struct(m["node_id"].alias("macro_id"), F.transform(ids, event).alias("micro_events"), F.transform(names, entity).alias("entities"), F.array().cast(f"array<{schema.nested(schema.EDGE)}>").alias("edges"), F.transform(items(m["ocr_texts"]), screen).alias("on_screen_texts"))
        own = [m[c].alias(c) for c in ("event_types", "ocr_texts", "dense_description", "asr_text")]
        key = F.transform(items(m["key_entities"]), lambda e: F.struct(_named(e)[0].alias("name"), _named(e)[1].alias("type")))
        # screen texts alone make no subgraph
        return F.struct(m["node_id"].alias("macro_id"), m["label"].alias("label"), m["time_range"].alias("time_range"), m["summary"].alias("summary"), key.alias("key_entities"), *own, F.when((F.size(ids) > 0) | (F.size(names) > 0), graph).alias("subgraph"), none.cast("string").alias("super_id"))

    def relation(r: Column) -> Column:
        return F.struct(*(F.coalesce(r[f"{p}{c}{s}"], r[c]).alias(c) for p, c, s in (("", "source", "_id"), ("", "target", "_id"), ("relation_", "type", ""))), r["reason"].alias("reason"))

    root = old["root_event"]
    root = F.struct(*(root[c].alias(c) for c in ("title", "description", "themes")), wrapped(root["key_entities"]).alias("key_entities"), root["emotional_tone"].alias("emotional_tone"))
    supers = F.transform(old["super_events"], lambda s: F.struct(s["node_id"].alias("super_id"), *(s[c].alias(c) for c in ("label", "description", "sub_macro_ids", "time_range")), wrapped(s["key_entities"]).alias("key_entities")))
    relations = [F.transform(old[c], relation).alias(c) for c in ("macro_relations", "super_relations")]
    return F.struct(old["graph_id"].alias("video_key"), F.lit("").alias("video_path"), root.alias("root"), supers.alias("super_events"), F.transform(old["macro_events"], macro).alias("macro_events"), *relations)


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """A row for each memory file under ``path`` (globs too), with its ``source`` path; absent keys are null.

    The layout is chosen by file: one with ``root_event`` is of the older layout and comes as the current one,
    with ``legacy`` true. A file that isn't a JSON object has null columns and ``broken`` true;
    one without bytes has no row.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("source"))
    parsed = F.try_parse_json("value")
    whole = whole.withColumn("broken", ~F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False)))
    legacy = F.coalesce(F.array_contains(F.json_object_keys("value"), "root_event"), F.lit(False))
    whole = whole.withColumn("legacy", ~F.col("broken") & legacy)
    new, old = F.when(~F.col("broken") & ~F.col("legacy"), F.from_json("value", schema.MEMORY)), F.when(F.col("legacy"), F.from_json("value", schema.LEGACY))
    whole = whole.select("source", "legacy", "broken", new.alias("new"), old.alias("old"))
    shape = schema.nested(schema.MEMORY)
    return whole.select("source", "legacy", "broken", F.when(F.col("legacy"), _from_legacy(F.col("old")).cast(shape)).otherwise(F.col("new")).alias("m")).select("m.*", "source", "legacy", "broken")


def scan_memories(spark: SparkSession, folder: str) -> DataFrame:
    """``read_memories`` of all ``*.memory/graph_memory.json`` in ``folder``, with ``pos``, their order by name."""
    from mnemograph.operators.rank import global_rank

    found = read_memories(spark, f"{folder.rstrip('/')}/*.memory/graph_memory.json")
    order = global_rank(found.select("source"), F.col("source"), name="pos")
    return found.join(order, "source")


def _range(items: Column) -> tuple[Column, Column]:
    """Start and end in seconds of a range; null unless it has two items."""
    two = F.size(items) >= 2
    return F.when(two, parse_item(items[0])).alias("t_start"), F.when(two, parse_item(items[1])).alias("t_end")


def _blank(df: DataFrame) -> DataFrame:
    return df.fillna("", [c for c, t in df.dtypes if t == "string" and c != "name"])


def tables(memories: DataFrame) -> dict[str, DataFrame]:
    """The tables of memories: roots, supers, macros, entities, events, screens, edges, relations."""
    key = "video_key"
    macros = memories.select(key, F.posexplode("macro_events").alias("pos", "m"), *(["legacy"] if "legacy" in memories.columns else []))
    macro = macros.select(key, "pos", "m.*", *(["legacy"] if "legacy" in memories.columns else []))
    if "legacy" in memories.columns:
        # the older layout has no way up: of the supers that list a macro the last one counts
        listed = memories.where("legacy").select(key, F.posexplode("super_events").alias("at", "s")).select(key, "at", F.col("s.super_id").alias("up"), F.explode("s.sub_macro_ids").alias("macro_id"))
        up = listed.groupBy(key, "macro_id").agg(F.max_by("up", "at").alias("up"))
        macro = macro.join(up, [key, "macro_id"], "left").withColumn("super_id", F.when(F.col("legacy"), F.coalesce("up", F.lit(""))).otherwise(F.col("super_id"))).drop("up", "legacy")
    sub = macro.where(F.col("subgraph").isNotNull()).select(key, "macro_id", "subgraph")

    def part(name: str) -> DataFrame:
        return _blank(sub.select(key, F.col("macro_id").alias("__m"), F.explode(f"subgraph.{name}").alias("x")).select(key, "__m", "x.*"))

    owned = lambda df: df.withColumn("macro_id", F.col("__m")).drop("__m")
    relations = [memories.select(key, F.explode(f"{level}_relations").alias("r"), F.lit(level).alias("level")).select(key, "r.*", "level") for level in ("macro", "super")]
    return {
        "roots": _blank(memories.select(key, "root.*")),
        "supers": _blank(memories.select(key, F.posexplode("super_events").alias("pos", "s")).select(key, "pos", "s.*").withColumns(dict(zip(("t_start", "t_end"), _range(F.col("time_range")), strict=True))).drop("time_range")),
        "macros": _blank(macro.drop("subgraph").withColumns(dict(zip(("t_start", "t_end"), _range(F.col("time_range")), strict=True))).drop("time_range")),
        "events": owned(part("micro_events").withColumns(dict(zip(("t_start", "t_end"), _range(F.col("time_range")), strict=True))).drop("time_range")),
        "entities": owned(part("entities")),
        "screens": owned(part("on_screen_texts").withColumns(dict(zip(("t_start", "t_end"), _range(F.col("time_range")), strict=True))).drop("time_range")),
        "edges": part("edges").withColumnRenamed("__m", "macro_id"),
        "relations": _blank(relations[0].unionByName(relations[1])),
    }


def write_tables(named: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under ``path``; the commit of a table is atomic."""
    for name, df in named.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def save_phase(df: DataFrame, path: str) -> None:
    """The result of a phase as JSON lines, which a later run reads by ``read_phase``."""
    df.write.mode("overwrite").json(path)


def read_phase(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A phase's saved rows; no rows where nothing was saved, and lines that aren't whole JSON are left out."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_index(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """(path, pos, node, vector, error) of embedding-index files: NumPy archives of a matrix ``embeddings`` and of
    ``nodes``, a JSON list with an object for each of its rows.

    Tasks read a file each, as an archive can't be split (under 2 GB), and give its rows in small batches. A file
    that can't be read, or whose parts differ in length, is one row with its error, so that its nodes can be
    built anew and joined by ``merge.joined_index``; files without bytes have no row. ``node`` is JSON text. ``files`` (path,
    content): archives that a table holds, in place of those at ``path``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    with np.load(io.BytesIO(content.as_buffer()), allow_pickle=False) as data:
                        matrix, nodes = data["embeddings"], json.loads(str(data["nodes"]))
                    if matrix.ndim != 2 or len(matrix) != len(nodes):
                        raise ValueError(f"{matrix.shape} vectors for {len(nodes)} nodes")
                except (ValueError, KeyError, OSError, EOFError, zipfile.BadZipFile) as e:
                    yield pa.RecordBatch.from_pylist([{"path": name, "error": f"{type(e).__name__}: {e}"}], INDEX)
                    continue
                for i in range(0, len(nodes), 1000):
                    some = [{"path": name, "pos": i + k, "node": json.dumps(x, ensure_ascii=False), "vector": v} for k, (x, v) in enumerate(zip(nodes[i : i + 1000], matrix[i : i + 1000].astype("float32").tolist(), strict=True))]
                    yield pa.RecordBatch.from_pylist(some, INDEX)

    found = (spark.read.format("binaryFile").load(path) if files is None else files).select("path", "content")
    return found.mapInArrow(rows, "path string, pos long, node string, vector array<float>, error string")


def read_list(spark: SparkSession, path: str, item: StructType | str) -> DataFrame:
    """Rows of checkpoint files that are one JSON list each, with ``source``; no rows where a file is absent, empty or broken.

    A list can't be split, so a file is one task's; phases of this library are saved by lines instead.
    """
    kind = item if isinstance(item, str) else item.simpleString()[7:-1].replace(":", " ")
    try:
        whole = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("source"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{kind}, source string")
    sound = F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("ARRAY"))
    return whole.where(sound).select("source", F.explode(F.from_json("value", f"array<{schema.nested(kind)}>")).alias("x")).where("x is not null").select("x.*", "source")


def read_subgraphs(spark: SparkSession, path: str | DataFrame, name: str = r"([^/]+)\.json$") -> DataFrame:
    """(macro_id, usable, subgraph) of per-macro files: ``name`` takes the macro's id from the path. Many small files may
    be the rows (path, value) of a table.

    A file that isn't a JSON object, or in whose lists something isn't one, is not usable and has no subgraph; one
    without events, entities and screen texts isn't usable either. Rows get the file's macro_id, whatever they say.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value") if isinstance(path, str) else path
    whole = files.select(F.regexp_extract("path", name, 1).alias("macro_id"), "value", F.try_parse_json("value").alias("v"))
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    sound = is_object(F.col("v"))
    for part in ("micro_events", "entities", "edges", "on_screen_texts"):
        there = F.try_variant_get("v", f"$.{part}", "variant")
        listed = F.try_variant_get("v", f"$.{part}", "array<variant>")
        sound = sound & F.coalesce(there.isNull() | F.forall(listed, is_object), F.lit(False))
    g = F.when(sound, F.from_json("value", schema.SUBGRAPH))
    blank = lambda c, d="": F.coalesce(c, F.lit(d))
    own = F.col("macro_id").alias("macro_id")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{schema.nested(kind)}>"))
    zero = F.array(F.lit("0"), F.lit("0"))
    events = F.transform(none(g["micro_events"], schema.MICRO), lambda e: F.struct(*(blank(e[c]).alias(c) for c in ("event_id", "event_type")), F.coalesce(e["time_range"], zero).alias("time_range"), *(blank(e[c]).alias(c) for c in ("subject", "object", "action", "description")), own))
    entities = F.transform(none(g["entities"], schema.ENTITY), lambda e: F.struct(blank(e["entity_id"]).alias("entity_id"), e["name"].alias("name"), blank(e["entity_type"], "OBJECT").alias("entity_type"), e["attributes"].alias("attributes"), blank(e["description"]).alias("description"), own))
    edges = F.transform(none(g["edges"], schema.EDGE), lambda e: F.struct(*(blank(e[c]).alias(c) for c in ("source_id", "target_id", "relation_label", "relation_type", "description"))))
    screens = F.transform(none(g["on_screen_texts"], schema.SCREEN), lambda e: F.struct(*(blank(e[c]).alias(c) for c in ("text_id", "text")), F.coalesce(e["time_range"], F.array().cast("array<string>")).alias("time_range"), blank(e["description"]).alias("description"), own))
    whole = whole.select("macro_id", sound.alias("sound"), F.struct(own, events.alias("micro_events"), entities.alias("entities"), edges.alias("edges"), screens.alias("on_screen_texts")).cast(schema.nested(schema.SUBGRAPH)).alias("subgraph"))
    some = (F.size("subgraph.micro_events") > 0) | (F.size("subgraph.entities") > 0) | (F.size("subgraph.on_screen_texts") > 0)
    return whole.select("macro_id", (F.col("sound") & some).alias("usable"), F.when(F.col("sound"), F.col("subgraph")).alias("subgraph"))


def with_subgraphs(macros: DataFrame, found: DataFrame) -> DataFrame:
    """``macros`` (macro_id, key_entities, event_types, ocr_texts, ..) with ``prebuilt``: whether a usable file was found.

    A macro with a sound file takes its subgraph and what follows from it: the first ten entities, the kinds of its
    events, its screen texts. Others keep what they have, and macros that aren't prebuilt have still to be worked on.
    """
    joined = macros.drop("subgraph").join(found, "macro_id", "left")
    g, there = F.col("subgraph"), F.col("subgraph").isNotNull()
    named = F.transform(F.slice(g["entities"], 1, 10), lambda e: F.struct(F.coalesce(F.nullif(e["name"], F.lit("")), e["entity_id"]).alias("name"), e["entity_type"].alias("type")))
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform(g["micro_events"], lambda e: e["event_type"]), lambda k: k != "")))
    taken = {"key_entities": named, "event_types": kinds, "ocr_texts": F.transform(g["on_screen_texts"], lambda t: t["text"])}
    return joined.withColumns({c: F.when(there, x).otherwise(F.col(c)) if c in macros.columns else F.when(there, x) for c, x in taken.items()}).withColumn("prebuilt", F.coalesce("usable", F.lit(False))).drop("usable")


def write_subgraphs(graphs: DataFrame, path: str, buckets: int = 64) -> None:
    """Subgraphs by ``macro_id`` so that one can be read alone: folders by the id's hash, each one file sorted by id, with
    a Bloom filter and statistics of small row groups and pages."""
    placed = graphs.withColumn("bucket", _bucket(F.col("macro_id"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "macro_id")
    writer = placed.write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#macro_id", "true").option("parquet.block.size", 4 << 20).option("parquet.page.row.count.limit", 1000)
    writer.parquet(path)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets)).cast("int")


def read_subgraph(spark: SparkSession, path: str, macro_id: str, buckets: int = 64) -> DataFrame:
    """The rows of one macro: the folder of its id's hash is opened and no other."""
    return spark.read.parquet(path).where((F.col("bucket") == crc32(macro_id.encode()) % buckets) & (F.col("macro_id") == macro_id)).drop("bucket")
