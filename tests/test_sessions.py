"""Session logs of both dialects, split and broken ones too."""

import json

from mnemograph.operators.trace import user_ancestors
from mnemograph.sources.files import read_session
from mnemograph.sources.sessions import item_stream, message_tree


def tables(pair):
    turns, blocks = ([tuple(r[c] for c in names) for r in df.orderBy(*names[:2]).collect()] for df, names in zip(pair, (("turn_no", "user_text"), ("turn_no", "block_no", "kind", "text", "name", "call_id", "input")), strict=True))
    return turns, blocks


def test_message_tree(spark, tmp_path):
    lines = [
        {"type": "user", "uuid": "u1", "message": {"content": "  first \n"}},
        {"type": "system", "uuid": "s1", "parentUuid": "u1"},
        {"type": "assistant", "uuid": "a1", "parentUuid": "s1", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t1", "name": "n", "input": {"k": 1}}, {"type": "odd"}]}},
        "broken {",
        {"type": "user", "uuid": "u2", "parentUuid": "a1", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "r"}, {"type": "image", "source": {"data": "x"}}, 5]}]}},
        {"type": "assistant", "uuid": "a2", "parentUuid": "u2", "message": {"content": [{"type": "text", "text": "done"}]}},
        {"type": "assistant", "uuid": "a3", "parentUuid": "a1", "message": {"content": [{"type": "text", "text": "late"}]}},
        {"type": "assistant", "uuid": "lost", "parentUuid": "nowhere", "message": {"content": [{"type": "text", "text": "?"}]}},
        {"type": "user", "uuid": "u3", "message": {"content": []}},
        {"type": "user", "uuid": "u4", "message": {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}},
        {"type": "user", "uuid": "u5", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "last"}]}},
        {"type": "assistant", "uuid": "x", "parentUuid": "y", "message": {"content": "plain"}},
        {"type": "system", "uuid": "y", "parentUuid": "x"},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    pair = message_tree(read_session(spark, str(tmp_path / "s.jsonl")))
    turns, blocks = tables(pair)
    # u2 has no text but blocks; u3 and u5 have neither
    assert turns == [(0, "first"), (4, ""), (9, "ab")]
    assert blocks == [(0, 0, "thinking", "hm", None, None, None), (0, 1, "tool", None, "n", "t1", '{"k":1}'), (0, 2, "text", "late", None, None, None), (4, 0, "text", "done", None, None, None)]
    tool = pair[1].where("kind = 'tool'").first()
    assert [tuple(x) for x in tool["result"]] == [("text", "last", None)] and tool["is_error"] is False
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) for x in lines[:10] if not isinstance(x, str)))
    tool = message_tree(read_session(spark, str(tmp_path / "s.jsonl")))[1].where("kind = 'tool'").first()
    assert [tuple(x) for x in tool["result"]] == [("text", "r", None), ("image", None, "image/png")] and tool["is_error"] is True


def test_item_stream(spark, tmp_path):
    item = lambda **p: {"type": "response_item", "payload": p}
    said = lambda role, *texts: item(type="message", role=role, content=[{"type": "input_text", "text": t} for t in texts] + ["odd"])
    lines = [
        said("assistant", "before"), {"type": "event_msg", "payload": {"type": "user_message", "message": "", "text": " ask me "}}, said("user", "context"), said("user", "ask", "me"), said("user", "ask me"),
        item(type="function_call", name="f", call_id="c1", arguments='{"a": 1}'), "no", item(type="custom_tool_call", name="g", call_id="c2", input="x"), item(type="reasoning"), item(type="function_call", name="h", call_id="c3", arguments="{}"),
        item(type="function_call_output", call_id="c1", output="plain"), item(type="function_call_output", call_id="c1", output=json.dumps([{"type": "output_text", "text": "t"}, 7, {"type": "input_image", "image_url": "data:image/jpeg;base64,QQ=="}, {"type": "image", "url": "http://x"}])),
        item(type="custom_tool_call_output", call_id="c2", output="{\"no\": \"list\"}"), said("assistant", " "), said("assistant", "end "), said("user", "ask me"), said("developer", "no"),
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    pair = item_stream(read_session(spark, str(tmp_path / "r.jsonl")))
    turns, blocks = tables(pair)
    assert turns == [(0, ""), (1, "ask me"), (2, "ask me")]
    assert blocks == [(0, 0, "text", "before", None, None, None), (1, 0, "tool", None, "f", "c1", '{"a": 1}'), (1, 1, "tool", None, "g", "c2", "x"), (1, 2, "tool", None, "h", "c3", "{}"), (1, 3, "text", "end", None, None, None)]
    results = {r["call_id"]: r["result"] and [tuple(x) for x in r["result"]] for r in pair[1].where("kind = 'tool'").collect()}
    assert results == {"c1": [("text", "t", None), ("text", "7", None), ("image", None, "image/jpeg")], "c2": [], "c3": None}


def test_lines_of_split_files(spark, tmp_path):
    """Turn numbers go on over the splits of a file, and files don't mix."""
    lines = []
    for i in range(900):
        lines += [{"type": "event_msg", "payload": {"type": "user_message", "message": f"q{i}"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": f"q{i}"}]}}]
        lines += [{"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": f"a{i}"}]}}]
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        turns, blocks = item_stream(read_session(spark, str(tmp_path / "*.jsonl")))
        assert blocks.join(turns, ["path", "turn_no"]).where("user_text = concat('q', turn_no - 1) and text = concat('a', turn_no - 1)").count() == 1800
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_log(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("")
    for read in (message_tree, item_stream):
        turns, blocks = read(read_session(spark, str(tmp_path / "e.jsonl")))
        assert turns.count() == blocks.count() == 0


def test_cycles_end(spark):
    rows = [(0, None, True), (1, 0, False), (2, 1, False), (3, 4, False), (4, 3, False), (5, 3, False), (6, 6, False), (7, 99, False)]
    got = user_ancestors(spark.createDataFrame(rows, "id long, parent long, is_user boolean"))
    assert dict(got.collect()) == {0: 0, 1: 0, 2: 0, 3: None, 4: None, 5: None, 6: None, 7: None}
