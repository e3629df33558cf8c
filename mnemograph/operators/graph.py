"""The memory hierarchy: drill-down, subgraphs, neighbours, cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.functions.text import or_na
from mnemograph.operators.rank import global_rank

STRONG_TYPES, STRONG_LABELS = ("CAUSAL", "SPATIAL"), ("USES_TOOL", "RECEIVES", "CONTEXT_FOR")


def visible(cutoff: float | None, start: Column | None = None) -> Column:
    """All rows without a cutoff; else those that start before it (a null start is hidden)."""
    return F.lit(True) if cutoff is None else F.coalesce((F.col("t_start") if start is None else start) < cutoff, F.lit(False))


def members(supers: DataFrame) -> DataFrame:
    """(super_id, pos, macro_id) from sub_macro_ids, or from supers that have a row a member already."""
    if "macro_id" in supers.columns:
        return supers.select("super_id", "pos", "macro_id")
    return supers.select("super_id", F.posexplode("sub_macro_ids").alias("pos", "macro_id"))


def super_events(supers: DataFrame, macros: DataFrame, cutoff: float | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Supers with their visible macros' number and ids in order; those without any are left out.

    ``listed`` (super_id, pos, macro_id), here and below: membership as rows, in place of the arrays sub_macro_ids.
    """
    seen = macros.where(visible(cutoff)).select("macro_id").distinct()
    kept = members(supers if listed is None else listed).join(seen, "macro_id").groupBy("super_id").agg(F.count("*").alias("num_macros"), F.array_sort(F.collect_list(F.struct("pos", "macro_id"))).alias("m"))
    return supers.drop("sub_macro_ids").join(kept, "super_id").withColumn("macro_ids", F.transform("m", lambda x: x["macro_id"])).drop("m")


def macro_events(macros: DataFrame, supers: DataFrame | None = None, super_id: str | None = None, macro_ids: list[str] | None = None, cutoff: float | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Macros by ids (their order, repeats kept, unknown ones dropped), else of a super, else all."""
    shown = macros.where(visible(cutoff))
    if macro_ids:
        asked = macros.sparkSession.createDataFrame(list(enumerate(macro_ids)), "pos int, macro_id string")
        return F.broadcast(asked).join(shown, "macro_id").orderBy("pos").drop("pos")
    if super_id:
        asked = members((supers if listed is None else listed).where(F.col("super_id") == super_id))
        if not supers.where(F.col("super_id") == super_id).limit(1).count():
            raise ValueError(f"unknown super event: {super_id}")
        return asked.drop("super_id").join(shown, "macro_id").orderBy("pos").drop("pos")
    return shown


def super_of_macro(supers: DataFrame, order: str = "super_id") -> DataFrame:
    """(macro_id, super_id): of several supers the last one that lists it, by column ``order``, then by id.

    Rows have no order of their own, so a file's order must come as a column (``pos`` of the supers' table).
    """
    macro = F.col("macro_id") if "macro_id" in supers.columns else F.explode("sub_macro_ids").alias("macro_id")
    listed = supers.select("super_id", F.struct(order, F.col("super_id").alias("id")).alias("at"), macro)
    return listed.groupBy("macro_id").agg(F.max_by("super_id", "at").alias("super_id"))


def super_ranges(supers: DataFrame, macros: DataFrame) -> DataFrame:
    """(super_id, t_start, t_end): from the first to the last second of its macros with a range; of a repeated
    macro all rows count."""
    timed = macros.where(F.col("t_start").isNotNull() & F.col("t_end").isNotNull()).select("macro_id", "t_start", "t_end")
    return members(supers).join(timed, "macro_id").groupBy("super_id").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))


def strong(edges: DataFrame) -> DataFrame:
    """Edges worth showing: causal and spatial ones, and labels of use, receipt and context."""
    return edges.where(F.col("relation_type").isin(*STRONG_TYPES) | F.col("relation_label").isin(*STRONG_LABELS))


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with source_label and target_label of nodes (node_id, label); unknown ones are ''."""
    ends = nodes.select("node_id", "label")
    a = ends.select(F.col("node_id").alias("source_id"), F.col("label").alias("source_label"))
    b = ends.select(F.col("node_id").alias("target_id"), F.col("label").alias("target_label"))
    return edges.join(a, "source_id", "left").join(b, "target_id", "left").fillna("", ["source_label", "target_label"])


def neighbours(edges: DataFrame, nodes: DataFrame, directed: DataFrame | None = None) -> DataFrame:
    """(node_id, neighbour_id, direction, relation_label, neighbour): every edge at both its ends (a loop
    twice), ``directed`` relations at their source only; a neighbour shows as "type: name", name or id.

    Filter on node_id first for one ego graph; hubs stay rows and are never gathered.
    """
    out = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbour_id"), F.lit("outgoing").alias("direction"), "relation_label")
    back = edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbour_id"), F.lit("incoming").alias("direction"), "relation_label")
    both = out.unionByName(back)
    if directed is not None:
        both = both.unionByName(directed.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbour_id"), F.lit("outgoing").alias("direction"), "relation_label"))
    names = nodes.select(F.col("node_id").alias("neighbour_id"), "node_type", "label")
    text = F.when(F.coalesce("label", F.lit("")) == "", F.col("neighbour_id").cast("string")).when(F.coalesce("node_type", F.lit("")) == "", F.col("label")).otherwise(F.concat_ws(": ", "node_type", "label"))
    return both.join(names, "neighbour_id", "left").select("node_id", "neighbour_id", "direction", "relation_label", text.alias("neighbour"))


def hit_details(hits: DataFrame, nodes: DataFrame, macros: DataFrame, supers: DataFrame, order: str = "super_id", listed: DataFrame | None = None) -> DataFrame:
    """Hits (node_id, ...) with their node, macro label and super label."""
    sup = super_of_macro(supers if listed is None else listed, order).join(supers.select("super_id", F.col("label").alias("super_label")), "super_id")
    mac = macros.select("macro_id", F.col("label").alias("macro_label"), "t_start", "t_end")
    return hits.join(nodes, "node_id", "left").join(mac, "macro_id", "left").join(sup, "macro_id", "left")


def kept_relations(relations: DataFrame, macros: DataFrame) -> DataFrame:
    """Relations with both ends among ``macros``."""
    ids = macros.select("macro_id").distinct()
    return relations.join(ids.withColumnRenamed("macro_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("macro_id", "target"), "target", "left_semi")


def has_content(entities: Column, events: Column, screens: Column) -> Column:
    return (F.size(F.coalesce(entities, F.array())) > 0) | (F.size(F.coalesce(events, F.array())) > 0) | (F.size(F.coalesce(screens, F.array())) > 0)


def provider_results(df: DataFrame, link: str, title: str, snippet: str, date: str | None) -> DataFrame:
    """One provider's results as (link, title, snippet, date); what is missing is N/A."""
    return df.select(or_na(F.col(link)).alias("link"), or_na(F.col(title)).alias("title"), or_na(F.col(snippet)).alias("snippet"), (or_na(F.col(date)) if date else F.lit("N/A")).alias("date"))


#: Where each shape of a search provider's answer has its rows, link, snippet and date (fixed values).
SHAPES = {"links": ("organic", "link", "snippet", "date"), "texts": ("results", "url", "text", "publishedDate"), "contents": ("results", "url", "content", "published_date")}


def answered(responses: DataFrame, first: int = 1) -> DataFrame:
    """(no, query_no, link, title, snippet, date) of search answers (query_no, shape, response as JSON), one union of
    the three shapes: numbered from ``first`` on over all queries, in their order; rows without a link are left out
    before, other things that are missing are N/A. An answer that is no JSON object has no rows."""
    row = "struct<link:string,url:string,title:string,snippet:string,text:string,content:string,date:string,publishedDate:string,published_date:string>"
    parsed = responses.select("query_no", "shape", F.from_json("response", f"organic array<{row}>, results array<{row}>").alias("r"))
    out = None
    for shape, (rows, link, snippet, date) in SHAPES.items():
        own = parsed.where(F.col("shape") == shape).select("query_no", F.posexplode(f"r.{rows}").alias("pos", "d"))
        own = own.select("query_no", "pos", F.coalesce(f"d.{link}", F.lit("")).alias("link"), *(or_na(F.col(f"d.{c}")).alias(n) for c, n in (("title", "title"), (snippet, "snippet"), (date, "date"))))
        out = own if out is None else out.unionByName(own)
    ranked = global_rank(out.where("link <> ''"), F.col("query_no"), F.col("pos"), name="no")
    return ranked.select((F.col("no") + first).alias("no"), "query_no", "link", "title", "snippet", "date")


def summary(roots: DataFrame) -> DataFrame:
    """(video_key, json) of each root, whatever the cutoff."""
    fields = ("title", "description", "themes", "key_entities", "emotional_tone")
    return roots.select("video_key", F.to_json(F.struct(*fields), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def macro_digest(entities: Column, events: Column, screens: Column) -> Column:
    """struct<key_entities, event_types, ocr_texts> of a subgraph: the first 10 entities by name or id, the
    distinct types of events, and all texts on screen."""
    none = lambda c: F.when(c == "", None).otherwise(c)
    named = F.transform(F.slice(entities, 1, 10), lambda e: F.struct(F.coalesce(none(e["name"]), e["entity_id"]).alias("name"), e["entity_type"].alias("type")))
    types = F.array_sort(F.array_distinct(F.filter(F.transform(events, lambda e: none(e["event_type"])), lambda t: t.isNotNull())))
    return F.struct(named.alias("key_entities"), types.alias("event_types"), F.transform(screens, lambda x: x["text"]).alias("ocr_texts"))


def prompt_json(macro_id: Column, label: Column, times: Column, text: Column) -> Column:
    """A macro as JSON for a prompt; ``times``: its range as texts."""
    return F.to_json(F.struct(macro_id.alias("macro_id"), label.alias("label"), times.alias("time_range"), text.alias("summary")))


def absolute(ranges: Column, start: Column) -> Column:
    """Times within a segment as times of the whole."""
    return F.transform(ranges, lambda t: t + start)
