"""Merging memories: id prefixes, renumbering, root roll-up, node tables, day offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.functions.text import packed_sentences
from mnemograph.functions.timeexpr import day_base
from mnemograph.operators.rank import global_rank


def short_key(name: Column) -> Column:
    """P and digits at the start, else what stands before the first _, 20 characters at most."""
    lead = F.regexp_extract(name, r"^(P[0-9]+)", 1)
    return F.substring(F.when(lead != "", lead).otherwise(F.substring_index(name, "_", 1)), 1, 20)


def prefixed(df: DataFrame, prefix: Column, columns: list[str]) -> DataFrame:
    """Ids and references with ``prefix_`` before them; empty ones stay empty. Arrays item by item."""
    types = dict(df.dtypes)
    mark = lambda c: F.when(F.coalesce(c, F.lit("")) == "", c).otherwise(F.concat(prefix, F.lit("_"), c))
    return df.withColumns({c: F.transform(c, mark) if types[c].startswith("array") else mark(F.col(c)) for c in columns})


def merged(memories: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """One table of several memories' tables, each under its prefix."""
    out = None
    for prefix, df in memories.items():
        own = prefixed(df, F.lit(prefix), columns)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def renumbered(macros: DataFrame, chunk: str = "chunk", start: str = "t_start", pos: str = "pos") -> DataFrame:
    """``macros`` with new_id macro_0000 and on, by start, chunk and position."""
    ranked = global_rank(macros, F.col(start), F.col(chunk), F.col(pos), name="n")
    return ranked.withColumn("new_id", F.format_string("macro_%04d", "n")).drop("n")


def root_rollup(roots: DataFrame, order: str = "pos") -> DataFrame:
    """One root of many (pos, title, themes, key_entities): sorted distinct themes (50), entities (100),
    the first 20 titles and how many more there are. Only the bounded lists reach one task."""
    themes = roots.select(F.explode("themes").alias("x")).distinct().orderBy("x").limit(50).agg(F.array_sort(F.collect_list("x")).alias("themes"))
    entities = roots.select(F.explode("key_entities").alias("x")).distinct().orderBy("x").limit(100).agg(F.array_sort(F.collect_list("x")).alias("key_entities"))
    first = roots.orderBy(order).limit(20).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "title"))), lambda x: x["title"]), "; ").alias("t"))
    n = roots.count()
    text = F.concat(F.col("t"), F.lit(f"... and {n - 20} more")) if n > 20 else F.col("t")
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(first.select(text.alias("description"))).join(one(themes), "__one").join(one(entities), "__one").drop("__one")


def source_counts(macros: DataFrame, supers: DataFrame, key: str) -> DataFrame:
    a = macros.groupBy(key).agg(F.count("*").alias("n_macros"))
    b = supers.groupBy(key).agg(F.count("*").alias("n_supers"))
    return a.join(b, key, "full_outer").fillna(0, ["n_macros", "n_supers"])


def transcript_nodes(macros: DataFrame, most: int = 500) -> DataFrame:
    """(node_id, node_type, text, macro_id) of transcripts in chunks; chunks under three characters are
    left out but keep their number."""
    chunks = macros.select("macro_id", F.posexplode(packed_sentences(F.coalesce("asr_text", F.lit("")), most)).alias("i", "text"))
    return chunks.where(F.length("text") >= 3).select(F.concat(F.lit("asr_"), F.col("macro_id").cast("string"), F.lit("_"), F.format_string("%03d", "i")).alias("node_id"), F.lit("asr_text").alias("node_type"), "text", F.col("macro_id").cast("string").alias("macro_id"))


def all_nodes(entities: DataFrame, events: DataFrame, screens: DataFrame, macros: DataFrame) -> DataFrame:
    """The search nodes of a memory: entities, events, on-screen texts, transcript chunks."""
    words = lambda *c: F.concat_ws(" ", *(F.when(F.coalesce(F.col(x), F.lit("")) != "", F.col(x)) for x in c))
    a = entities.select(F.col("entity_id").alias("node_id"), F.lit("entity").alias("node_type"), words("name", "description").alias("text"), "macro_id")
    b = events.select(F.col("event_id").alias("node_id"), F.lit("event").alias("node_type"), words("subject", "action", "object", "description").alias("text"), "macro_id")
    c = screens.select(F.col("text_id").alias("node_id"), F.lit("on_screen_text").alias("node_type"), words("text", "description").alias("text"), "macro_id")
    return a.unionByName(b).unionByName(c).unionByName(transcript_nodes(macros))


def rebased(macros: DataFrame) -> DataFrame:
    """Times of macros named DAYn_... moved to their day's recording start, unless the first such macro
    (by id) is already there."""
    day = F.regexp_extract("macro_id", r"^DAY([0-9]+)_", 1).try_cast("int")
    base = day_base(day)
    first = macros.where(day.isNotNull() & F.col("t_start").isNotNull()).select(F.min_by((F.col("t_start") >= base), "macro_id").alias("done")).first()
    if first["done"]:
        return macros
    return macros.withColumns({c: F.when(day.isNotNull(), F.col(c) + base).otherwise(F.col(c)) for c in ("t_start", "t_end")})


def joined_index(good: list[DataFrame], rebuilt: list[DataFrame]) -> DataFrame:
    """Nodes with vectors of several indexes, each with its place (``part``): those that were read, then those
    that had to be built anew."""
    parts = [df.withColumn("part", F.lit(i)) for i, df in enumerate([*good, *rebuilt])]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def merged_chunks(macros: DataFrame, supers: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of one video put together: macros get ids macro_0000 and on by start, chunk and position, and so does
    everything that names them.

    ``macros`` (chunk, pos, macro_id, t_start, subgraph, ..), ``supers`` (chunk, super_id, sub_macro_ids, ..) and ``relations``
    (chunk, source, target, ..). A subgraph's own id and those of its events, entities and screen texts follow its
    macro's. References meet the new ids in joins by chunk and id; a reference to no macro is left out, as is a relation
    with one. Only a super's own list of macros is gathered.
    """
    ranked = renumbered(macros)
    # of macros with one id in a chunk the first in order is the one that is meant
    ids = ranked.groupBy("chunk", "macro_id").agg(F.min("new_id").alias("new_id"))
    if "subgraph" in macros.columns:
        owned = lambda part: F.transform(F.col(f"subgraph.{part}"), lambda x: x.withField("macro_id", F.col("new_id")))
        graph = F.col("subgraph").withField("macro_id", F.col("new_id"))
        for part in ("micro_events", "entities", "on_screen_texts"):
            if part in macros.schema["subgraph"].dataType.names:
                graph = graph.withField(part, owned(part))
        ranked = ranked.withColumn("subgraph", F.when(F.col("subgraph").isNotNull(), graph))
    new_macros = ranked.withColumn("macro_id", F.col("new_id")).drop("new_id")
    listed = supers.select("chunk", "super_id", F.posexplode("sub_macro_ids").alias("__at", "macro_id")).join(ids, ["chunk", "macro_id"])
    lists = listed.groupBy("chunk", "super_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "new_id"))), lambda x: x["new_id"]).alias("__ids"))
    new_supers = supers.join(lists, ["chunk", "super_id"], "left").withColumn("sub_macro_ids", F.coalesce("__ids", F.array().cast("array<string>"))).drop("__ids")
    out = relations
    for end in ("source", "target"):
        out = out.join(ids.select("chunk", F.col("macro_id").alias(end), F.col("new_id").alias(f"__{end}")), ["chunk", end])
    out = out.withColumns({"source": F.col("__source"), "target": F.col("__target")}).drop("__source", "__target")
    return new_macros, new_supers, out.select(*relations.columns)
