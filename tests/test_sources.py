"""Readers, writers and the file stream on small files."""

import json

import numpy as np
from pyspark.sql import functions as F

from mnemograph.operators import graph, merge
from mnemograph.sources import files, memory
from mnemograph.streaming.incremental import process_new

MEMORY = {
    "video_key": "v1",
    "root": {"title": "T", "description": "D", "themes": ["a"], "key_entities": ["x"]},
    "super_events": [{"super_id": "super_00", "label": "S", "sub_macro_ids": ["macro_0000", "macro_0001"], "time_range": [0, 20]}],
    "macro_events": [
        {"macro_id": "macro_0000", "label": "A", "time_range": [0, "00:00:10"], "subgraph": {"macro_id": "macro_0000", "entities": [{"entity_id": "e0", "name": None}], "micro_events": [{"event_id": "m0", "time_range": [1, 2]}], "edges": [{"source_id": "m0", "target_id": "e0"}], "on_screen_texts": []}},
        {"macro_id": "macro_0001", "label": "B", "time_range": []},
    ],
    "macro_relations": [{"source": "macro_0000", "target": "macro_0001", "type": "CAUSAL"}],
}


def test_memory(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MEMORY))
    t = memory.tables(memory.read_memories(spark, str(tmp_path / "m.json")))
    got = {r["macro_id"]: (r["t_start"], r["t_end"], r["summary"]) for r in t["macros"].collect()}
    assert got == {"macro_0000": (0.0, 10.0, ""), "macro_0001": (None, None, "")}
    assert [r["event_id"] for r in t["events"].collect()] == ["m0"]
    assert t["relations"].count() == 1 and t["supers"].first()["t_end"] == 20.0
    memory.write_tables({"macros": t["macros"]}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/macros")).count() == 2


OLD = {
    "graph_id": "old", "root_event": {"title": "LT", "key_entities": ["hero", {"name": "dog", "type": "animal"}]},
    "super_events": [{"node_id": "s0", "label": "S", "sub_macro_ids": ["m0", "m1"]}, {"node_id": "s1", "sub_macro_ids": ["m1"]}],
    "macro_events": [
        {"node_id": "m0", "label": "M", "time_range": [0, 10], "subevent_ids": ["ea", "eb", "ec"], "event_summaries": ["x" * 100, ""], "key_entity_names": ["N", "O"], "key_entity_types": ["person"], "ocr_texts": ["TITLE"]},
        {"node_id": "m1", "key_entities": ["a", {"name": "b"}]},
        {"node_id": "m2", "ocr_texts": ["alone"]},
    ],
    "macro_relations": [{"source_id": "m0", "target": "m1", "relation_type": "self"}],
}


def test_legacy_beside_current(spark, tmp_path):
    for name, text in {"a": json.dumps(MEMORY), "b": json.dumps(OLD), "c": json.dumps(OLD)[:150], "d": "[1]", "e": ""}.items():
        (tmp_path / f"{name}.memory").mkdir()
        (tmp_path / f"{name}.memory" / "graph_memory.json").write_text(text)
    found = memory.scan_memories(spark, str(tmp_path))
    rows = {r["pos"]: (r["video_key"], r["legacy"], r["broken"]) for r in found.collect()}
    assert rows == {0: ("v1", False, False), 1: ("old", True, False), 2: (None, False, True), 3: (None, False, True)}  # none of the file without bytes
    t = {k: [r for r in v.collect() if r["video_key"] == "old"] for k, v in memory.tables(found).items()}
    assert t["roots"][0]["key_entities"] == ['{"name":"hero"}', '{"name":"dog","type":"animal"}']
    assert {r["macro_id"]: r["super_id"] for r in t["macros"]} == {"m0": "s0", "m1": "s1", "m2": ""}
    assert [(r["event_id"], len(r["action"]), r["event_type"], r["t_end"]) for r in t["events"]] == [("ea", 80, "action", 10.0), ("eb", 2, "action", 10.0), ("ec", 2, "action", 10.0)]
    assert [tuple(r[c] for c in ("macro_id", "entity_id", "name", "entity_type", "description")) for r in t["entities"]] == [("m0", "ent_001", "N", "person", "N"), ("m0", "ent_002", "O", "unknown", "O"), ("m1", "ent_001", "a", "unknown", "a"), ("m1", "ent_002", "b", "unknown", "b")]
    assert [(r["macro_id"], r["text_id"], r["text"]) for r in t["screens"]] == [("m0", "ocr_001", "TITLE")]
    assert [(r["source"], r["target"], r["type"]) for r in t["relations"]] == [("m0", "m1", "self")]
    assert [r["macro_id"] for r in memory.tables(found)["macros"].where("video_key = 'v1'").orderBy("pos").collect()] == ["macro_0000", "macro_0001"]


def test_subgraph_files(spark, tmp_path):
    whole = {"macro_id": "other", "micro_events": [{"event_id": "e", "event_type": "x"}, {"event_type": "x"}], "entities": [{"name": None, "entity_id": f"i{i}"} for i in range(12)], "edges": [{"source_id": 3, "target_id": "e"}], "on_screen_texts": [{"text": "T"}]}
    texts = {"m0": json.dumps(whole), "m1": json.dumps(whole)[:60], "m2": "", "m3": "[]", "m4": '{"entities": [1]}', "m5": '{"entities": {}}', "m6": "{}"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    macros = spark.createDataFrame([(f"m{i}", ["old"]) for i in range(8)], "macro_id string, ocr_texts array<string>")
    got = {r["macro_id"]: r for r in memory.with_subgraphs(macros, memory.read_subgraphs(spark, str(tmp_path / "*.json"))).collect()}
    assert {k: (r["prebuilt"], r["ocr_texts"]) for k, r in got.items()} == {"m0": (True, ["T"]), "m6": (False, []), **{f"m{i}": (False, ["old"]) for i in (1, 2, 3, 4, 5, 7)}}
    g = got["m0"]
    assert len(g["key_entities"]) == 10 and g["key_entities"][0] == ("i0", "OBJECT") and g["event_types"] == ["x"]
    assert g["subgraph"]["micro_events"][1]["time_range"] == ["0", "0"] and g["subgraph"]["micro_events"][0]["macro_id"] == "m0" and g["subgraph"]["edges"][0]["source_id"] == "3"


def test_checkpoint_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"macro_id": "m0", "n": 1}, {"macro_id": "m1"}]')
    (tmp_path / "b.json").write_text('[{"macro_id": "m2"}, {"mac')
    (tmp_path / "c.json").write_text("")
    got = memory.read_list(spark, str(tmp_path / "*.json"), "macro_id string, n long")
    assert sorted((r["macro_id"], r["n"]) for r in got.collect()) == [("m0", 1), ("m1", None)]
    assert memory.read_list(spark, str(tmp_path / "none.json"), "macro_id string, n long").count() == 0


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello\nworld\n\n2\n00:00:03,000 --> 00:00:04,000\nbye\n")
    assert [(r["time"], r["text"]) for r in files.read_srt(spark, str(tmp_path / "a.srt")).orderBy("cue").collect()] == [("00:00:01,000 --> 00:00:02,000", "hello world"), ("00:00:03,000 --> 00:00:04,000", "bye")]
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhello\nworld\n\n00:03.000 --> 00:04.000\nbye\n")
    assert [r["text"] for r in files.read_vtt(spark, str(tmp_path / "a.vtt")).orderBy("cue").collect()] == ["hello world", "bye"]


def test_other_files(spark, tmp_path):
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"], "outputs": [{"t": 1}]}, {"cell_type": "markdown", "source": "# x"}]}))
    cells = files.read_notebook(spark, str(tmp_path / "n.ipynb"))
    assert [r["source"] for r in cells.orderBy("cell").collect()] == ["a\nb", "# x"]
    assert tuple(files.notebook_counts(cells).first())[1:] == (1, 1)
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"name": "x"}}]}))
    g = files.read_geojson(spark, str(tmp_path / "g.geojson")).first()
    assert (g["geometry_type"], g["properties"]) == ("Point", {"name": "x"})
    (tmp_path / "c.env").write_text("# no\nexport A='1'\nB=two # note\nA=\"3\"\n")
    assert {r["key"]: r["value"] for r in files.read_dotenv(spark, str(tmp_path / "c.env")).collect()} == {"A": "3", "B": "two"}
    (tmp_path / "s.jsonl").write_text('{"a": 1}\nbroken\n[1]\n')
    assert files.read_session(spark, str(tmp_path / "s.jsonl")).count() == 1
    (tmp_path / "c.py").write_text("\n".join(map(str, range(600))))
    assert files.read_code(spark, str(tmp_path / "c.py")).first()["truncated"]
    assert files.scan_assets(spark, str(tmp_path)).count() == 0  # no folder of assets


def test_session_lines_are_numbered_across_blocks(spark, tmp_path):
    want = {}
    for name, n in (("a", 90), ("b", 3), ("empty", 0)):
        lines = ["broken" if i % 7 == 3 else json.dumps({"i": i, "x": "y" * (i % 11)}) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
        want |= {(f"{name}.jsonl", i): x for i, x in enumerate(lines) if x != "broken"}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        got = files.read_session(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 4
        assert {(r["path"].rsplit("/", 1)[1], r["line_no"]): r["line"] for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_last_super_wins_by_place(spark):
    supers = spark.createDataFrame([(2, "a", ["m", "n"]), (1, "b", ["m"]), (3, "c", None)], "pos int, super_id string, sub_macro_ids array<string>")
    assert sorted(tuple(r) for r in graph.super_of_macro(supers.repartition(3), "pos").collect()) == [("m", "a"), ("n", "a")]
    assert sorted(tuple(r) for r in graph.super_of_macro(supers).collect()) == [("m", "b"), ("n", "a")]


def test_index_files(spark, tmp_path):
    nodes = [{"node_id": f"n{i}", "text": "é"} for i in range(2500)]
    vectors = np.arange(5000, dtype=np.float32).reshape(2500, 2)
    np.savez(tmp_path / "good.npz", embeddings=vectors, nodes=json.dumps(nodes))
    np.savez(tmp_path / "short.npz", embeddings=vectors[:1], nodes=json.dumps(nodes))
    np.savez(tmp_path / "part.npz", embeddings=vectors)
    np.savez(tmp_path / "none.npz", embeddings=vectors[:0], nodes="[]")
    (tmp_path / "cut.npz").write_bytes((tmp_path / "good.npz").read_bytes()[:900])
    (tmp_path / "void.npz").write_bytes(b"")  # Spark's file scan leaves files without bytes out
    got = memory.read_index(spark, str(tmp_path)).collect()
    good = {r["pos"]: (json.loads(r["node"]), list(r["vector"])) for r in got if r["error"] is None}
    assert good == {i: (n, v.tolist()) for i, (n, v) in enumerate(zip(nodes, vectors, strict=True))}
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got if r["error"]) == ["cut.npz", "part.npz", "short.npz"]


def test_stream_takes_each_key_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for batch in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in batch], "id long").coalesce(1).write.mode("append").parquet(src)
        process_new(spark, src, "id long", "id", out, ck)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_phases(spark, tmp_path):
    kind = "macro_id string, n long"
    assert memory.read_phase(spark, str(tmp_path / "none"), kind).count() == 0
    memory.save_phase(spark.createDataFrame([("a", 1), ("b", None)], kind), str(tmp_path / "saved"))
    (tmp_path / "saved" / "part-broken.json").write_text('{"macro_id": "c", "n": 3}\n{"macro_id": "d", "n"')
    assert sorted(tuple(r) for r in memory.read_phase(spark, str(tmp_path / "saved"), kind).collect()) == [("a", 1), ("b", None), ("c", 3)]


def test_joined_index(spark):
    a, b = (spark.createDataFrame([(i, [1.0])], "node_id string, vector array<float>") for i in "ab")
    assert sorted((r.part, r.node_id) for r in merge.joined_index([b], [a]).collect()) == [(0, "b"), (1, "a")]


def test_numeric_split(spark):
    rows = spark.createDataFrame([("x", 1.5), ("y", None)], "geometry string, `a.b` double")
    name, there, absent = files.numeric_split(rows)
    assert (name, there.count(), absent.count()) == ("a.b", 1, 1)
    assert files.numeric_split(rows.select("geometry"))[0] is None
