"""Session logs of two dialects as turns and blocks.

Both give ``turns`` (path, turn_no, user_text) and ``blocks`` (path, turn_no, block_no, kind, text, name,
call_id, input, result, is_error): kinds are text, thinking and tool; a tool's ``result`` is an array of items
(kind, text, media_type), null where none came. Calls and results meet by their id within a file,
wherever the result stands; of several results the last line's counts. Broken lines are left out.

* Message trees: lines of type user and assistant with ``uuid`` and ``parentUuid``. A user line is a turn; an
  assistant's blocks belong to the nearest user line above it, through lines of any type, and are lost without
  one. ``turn_no`` is the user line's number in its file. Of lines with one uuid the last counts.
* Item streams: a user message is a turn if its text is one of the file's prompt events, and what follows belongs
  to it; blocks before any prompt are turn 0. Other user messages are context that was put in, and left out.

Defined cases: content that is neither text nor a list is empty; a turn without text or blocks is left out; an
empty file gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.operators.rank import running_count
from mnemograph.operators.trace import user_ancestors

ITEM = "struct<kind:string,text:string,media_type:string>"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path), F.lit(""))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _item(kind: str, text: Column | None = None, media: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), (none if text is None else text).alias("text"), (none if media is None else media).alias("media_type"))


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.select("path", "line_no", F.try_parse_json("line").alias("v")).withColumn("kind", _get(F.col("v"), "$.type"))


def _last_results(results: DataFrame) -> DataFrame:
    return results.groupBy("path", "call_id").agg(F.max_by(F.struct("result", "is_error"), F.struct("line_no", "pos")).alias("r")).select("path", "call_id", "r.result", "r.is_error")


def _finished(blocks: DataFrame, results: DataFrame) -> DataFrame:
    order = Window.partitionBy("path", "turn_no").orderBy("line_no", "pos")
    numbered = blocks.withColumn("block_no", F.row_number().over(order) - 1)
    joined = numbered.join(_last_results(results), ["path", "call_id"], "left")
    return joined.select("path", "turn_no", "block_no", "kind", "text", "name", "call_id", "input", "result", "is_error")


def message_tree(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and blocks of (path, line_no, line) in the message-tree dialect."""
    v = F.col("v")
    rows = _parsed(lines).withColumn("uuid", _text(v, "$.uuid")).withColumn("parent", _text(v, "$.parentUuid"))
    last = Window.partitionBy("path", "uuid").orderBy(F.desc("line_no"))
    rows = rows.where("uuid <> ''").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    at = lambda c: F.when(F.col(c) != "", F.struct(F.col("path"), F.col(c).alias("uuid")))
    users = F.col("kind") == "user"
    above = user_ancestors(rows.select(at("uuid").alias("id"), at("parent").alias("parent"), F.coalesce(users, F.lit(False)).alias("is_user")))
    above = above.where("ancestor is not null").select("id.path", "id.uuid", F.col("ancestor.uuid").alias("turn_id"))

    whole = _get(v, "$.message.content", "variant")
    messages = rows.where(F.col("kind").isin("user", "assistant")).withColumn("content", whole).withColumn("parts", _get(v, "$.message.content", "array<variant>"))
    asked = messages.where(users)
    texts = F.array_join(F.transform(F.filter("parts", lambda b: _get(b, "$.type") == "text"), lambda b: _text(b, "$.text")), "")
    text = F.when(F.col("parts").isNotNull(), texts).when(_is_text(F.col("content")), F.col("content").try_cast("string")).otherwise(F.lit(""))
    turns = asked.select("path", F.col("line_no").alias("turn_no"), F.col("uuid").alias("turn_id"), _stripped(text).alias("user_text"))

    given = asked.select("path", "line_no", F.posexplode("parts").alias("pos", "b")).where(_get(F.col("b"), "$.type") == "tool_result")
    parts, b = _get(F.col("b"), "$.content", "array<variant>"), F.col("b")
    listed = F.transform(F.filter(parts, lambda x: _get(x, "$.type").isin("text", "image")), lambda x: F.when(_get(x, "$.type") == "text", _item("text", _text(x, "$.text"))).otherwise(_item("image", None, F.coalesce(_get(x, "$.source.media_type"), F.lit("image/png")))))
    inner = _get(b, "$.content", "variant")
    # without any content it is one empty text
    result = F.when(parts.isNotNull(), listed).when(inner.isNull() | _is_text(inner), F.array(_item("text", _text(b, "$.content")))).otherwise(F.array().cast(f"array<{ITEM}>"))
    results = given.select("path", "line_no", "pos", _text(b, "$.tool_use_id").alias("call_id"), result.alias("result"), F.coalesce(_get(b, "$.is_error", "boolean"), F.lit(False)).alias("is_error"))

    kind = F.element_at(F.create_map(*map(F.lit, ("thinking", "thinking", "tool_use", "tool", "text", "text"))), _text(b, "$.type"))
    said = messages.where("kind = 'assistant'").join(above, ["path", "uuid"]).select("path", "turn_id", "line_no", F.posexplode("parts").alias("pos", "b")).withColumn("kind", kind).where("kind is not null")
    tool = F.col("kind") == "tool"
    said = said.select(
        "path", "turn_id", "line_no", "pos", "kind", F.when(F.col("kind") == "thinking", _text(b, "$.thinking")).when(~tool, _text(b, "$.text")).alias("text"),
        F.when(tool, _text(b, "$.name")).alias("name"), F.when(tool, _text(b, "$.id")).alias("call_id"), F.when(tool, F.coalesce(_get(b, "$.input", "variant").try_cast("string"), F.lit("{}"))).alias("input"),
    )
    blocks = _finished(said.join(turns.select("path", "turn_id", "turn_no"), ["path", "turn_id"]), results)
    kept = turns.join(blocks.select("path", "turn_no").distinct().withColumn("some", F.lit(True)), ["path", "turn_no"], "left").where("some or user_text <> ''")
    return kept.select("path", "turn_no", "user_text"), blocks


def item_stream(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and blocks of (path, line_no, line) in the item-stream dialect."""
    rows = _parsed(lines).withColumn("p", _get(F.col("v"), "$.payload", "variant"))
    p = F.col("p")
    rows = rows.withColumn("item", _get(p, "$.type"))
    prompt = _stripped(F.coalesce(F.nullif(_get(p, "$.message"), F.lit("")), _get(p, "$.text"), F.lit("")))
    prompts = rows.where("kind = 'event_msg' and item = 'user_message'").select("path", prompt.alias("text")).where("text <> ''").distinct()

    items = rows.where("kind = 'response_item'")
    texts = F.filter(_get(p, "$.content", "array<variant>"), lambda c: _get(c, "$.type").isin("input_text", "output_text", "text"))
    said = items.where("item = 'message'").withColumn("text", _stripped(F.coalesce(F.array_join(F.transform(texts, lambda c: _text(c, "$.text")), "\n"), F.lit("")))).withColumn("role", _get(p, "$.role"))
    opened = said.where("role = 'user'").join(prompts, ["path", "text"], "left_semi").select("path", "line_no", F.lit("prompt").alias("kind"), "text")
    none = F.lit(None).cast("string")
    answers = said.where("role = 'assistant' and text <> ''").select("path", "line_no", F.lit("text").alias("kind"), "text")
    called = F.when(F.col("item") == "custom_tool_call", _get(p, "$.input", "variant")).otherwise(_get(p, "$.arguments", "variant")).try_cast("string")
    calls = items.where(F.col("item").isin("custom_tool_call", "function_call")).select("path", "line_no", F.lit("tool").alias("kind"), none.alias("text"), _text(p, "$.name").alias("name"), _text(p, "$.call_id").alias("call_id"), called.alias("input"))
    stream = running_count(opened.unionByName(answers).unionByName(calls, allowMissingColumns=True), ["path"], "line_no", F.col("kind") == "prompt", "turn_no")

    output = _get(p, "$.output", "variant")
    text = F.when(_is_text(output), output.try_cast("string"))
    inner = F.try_parse_json(text)
    listed = F.when(text.isNull(), _get(p, "$.output", "array<variant>")).otherwise(_get(inner, "$", "array<variant>"))
    url = lambda x: F.coalesce(F.nullif(_get(x, "$.image_url"), F.lit("")), _get(x, "$.url"), F.lit(""))
    data = lambda x: F.regexp_extract(url(x), r"(?s)^data:(.*?);base64,(.+)$", 1)
    of = lambda x: _get(x, "$.type")
    is_text, is_image, whole = (lambda x: of(x).isin("input_text", "output_text", "text")), (lambda x: of(x).isin("input_image", "output_image", "image") & url(x).rlike(r"(?s)^data:.*?;base64,.")), (lambda x: ~F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    found = F.filter(listed, lambda x: F.coalesce(is_text(x) | is_image(x), F.lit(False)) | whole(x))
    shown = F.transform(found, lambda x: F.when(whole(x), _item("text", x.try_cast("string"))).when(is_text(x), _item("text", _text(x, "$.text"))).otherwise(_item("image", None, F.coalesce(F.nullif(data(x), F.lit("")), F.lit("image/png")))))
    result = F.when(text.isNotNull() & inner.isNull(), F.array(_item("text", text))).otherwise(F.coalesce(shown, F.array().cast(f"array<{ITEM}>")))
    results = items.where(F.col("item").isin("custom_tool_call_output", "function_call_output")).select("path", "line_no", F.lit(0).alias("pos"), _text(p, "$.call_id").alias("call_id"), result.alias("result"), F.lit(False).alias("is_error"))

    blocks = _finished(stream.where("kind <> 'prompt'").withColumn("pos", F.lit(0)), results)
    turns = stream.where("kind = 'prompt'").select("path", "turn_no", F.col("text").alias("user_text"))
    first = blocks.where("turn_no = 0").select("path", "turn_no", F.lit("").alias("user_text")).distinct()
    return turns.unionByName(first), blocks
