"""Notebooks, drawings, probes, tools' lines and search answers on small inputs with odd parts."""

import base64
import json
import urllib.parse
import zlib

from pyspark.sql import functions as F

from mnemograph.functions.text import tool_line
from mnemograph.operators.graph import answered
from mnemograph.operators.interval import time_hits
from mnemograph.sources.documents import drawing_cells, notebook_blocks, probe_tables


def test_notebook(spark, tmp_path):
    image = {"output_type": "display_data", "data": {"image/png": ["Q", "Q=="], "text/plain": "gone"}}
    outputs = [{"output_type": "stream", "name": "stderr", "text": ["a\n", "b" * 30]}, {"output_type": "stream", "text": " \n"}, {"output_type": "error", "ename": "E"}, image, {"output_type": "execute_result", "data": {"text/plain": ["x", "y"]}}, {"output_type": "display_data", "data": {"text/html": "h"}}, image, image]
    cells = [{"cell_type": "markdown", "source": " # T \n"}, {"cell_type": "code", "source": ["a = 1\n", "b"], "execution_count": 4, "outputs": outputs}, {"cell_type": "raw", "source": "r"}, {"cell_type": "code", "source": "", "execution_count": None, "outputs": []}, {"cell_type": "code", "source": "c", "execution_count": None}]
    (tmp_path / "a.ipynb").write_text(json.dumps({"cells": cells}))
    (tmp_path / "b.ipynb").write_text("{broken")
    got = [(r["block_no"], r["kind"], r["text"]) for r in notebook_blocks(spark, str(tmp_path / "*.ipynb"), most_images=2, most_chars=10).orderBy("block_no").collect()]
    assert got == [
        (0, "text", "# T"), (1, "text", "In [4]:\n```python\na = 1\nb\n```"), (2, "text", "[stderr]\na\nbbbbbbbb\n... (truncated)"), (3, "text", "[error] E: "), (4, "image", "QQ=="),
        (5, "text", "Out: xy"), (6, "image", "QQ=="), (7, "text", "In [ ]:\n```python\nc\n```"), (8, "text", "... (image outputs capped at 2; raise max_pages for more)"),
    ]


def test_a_notebook_of_many_cells(spark, tmp_path):
    """Places in a notebook passed a whole number's 32 bits from cell 2,148 on."""
    cells = [{"cell_type": "code", "source": "", "outputs": [{"output_type": "error", "ename": "E", "evalue": str(i)}, {"output_type": "display_data", "data": {"image/png": f"{i}"}}]} for i in range(4500)]
    (tmp_path / "a.ipynb").write_text(json.dumps({"cells": cells}))
    (tmp_path / "list.ipynb").write_text(json.dumps([{"cells": cells[:2]}]))
    (tmp_path / "cut.ipynb").write_text(json.dumps({"cells": cells[:2]})[:-3])
    got = [(r["block_no"], r["kind"], r["text"]) for r in notebook_blocks(spark, str(tmp_path / "*.ipynb"), most_images=4499).orderBy("block_no").collect()]
    want = [x for i in range(4500) for x in (("text", f"[error] E: {i}"), ("image", str(i)))][:-1] + [("text", "... (image outputs capped at 4499; raise max_pages for more)")]
    assert got == [(i, *x) for i, x in enumerate(want)]


def test_drawings_in_three_encodings(spark, tmp_path):
    model = '<mxGraphModel dx="1"><root><mxCell id="0"/><mxCell id="1" parent="0"/>\n<mxCell id="a" value="A &amp; B" style="ellipse" vertex="1"><mxGeometry x="1.5" y="2" width="10" height="20" as="geometry"/></mxCell><mxCell id="e" edge="1"><mxGeometry relative="1"><mxPoint x="9" y="9"/></mxGeometry></mxCell></root></mxGraphModel>'
    press = zlib.compressobj(wbits=-15)
    deflated = base64.b64encode(press.compress(model.encode()) + press.flush()).decode()
    escaped = model.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    for name, text in {"raw": f"\n  {model}\n", "url": urllib.parse.quote(model, safe=""), "zip": deflated[:40] + "\n" + deflated[40:], "esc": escaped, "bad": "%%%", "none": ""}.items():
        (tmp_path / f"{name}.drawio").write_text(f'<mxfile><diagram id="1">{text}</diagram></mxfile>')
    rows = {}
    for r in drawing_cells(spark, str(tmp_path / "*.drawio")).collect():
        rows.setdefault(r["path"].rsplit("/", 1)[1], []).append(tuple(r[c] for c in ("id", "label", "style", "is_edge", "x", "y", "width", "height")))
    want = [("a", "A & B", "ellipse", False, 1.5, 2.0, 10.0, 20.0), ("e", "", "", True, 0.0, 0.0, 0.0, 0.0)]
    assert {k: sorted(v) for k, v in rows.items()} == {f"{n}.drawio": want for n in ("raw", "url", "zip", "esc")}


def test_probe(spark):
    text = {"format": {"duration": "12.5", "bit_rate": "N/A"}, "streams": [{"codec_type": "video", "avg_frame_rate": "25/1", "tags": {"rotate": "90"}, "side_data_list": [{"k": 1}]}, {"index": 5, "codec_type": "audio", "channels": 2, "disposition": {"default": 1}, "tags": {"language": "ger"}}], "chapters": [{"start_time": "0.0", "end_time": "3", "tags": {"title": "In"}}]}
    df = spark.createDataFrame([("a", json.dumps(text)), ("b", "{"), ("c", None)], "path string, text string")
    t = probe_tables(df)
    assert [(r["index"], r["codec_type"], r["rate"], r["rotation"], r["language"], r["flags"]) for r in t["streams"].where("path = 'a'").orderBy("index").collect()] == [(0, "video", 25.0, 90, None, []), (5, "audio", 0.0, None, "ger", ["default"])]
    assert [tuple(r) for r in t["chapters"].collect()] == [("a", 0, 0.0, 3.0, "In")]
    assert {r["path"]: (r["duration"], r["bit_rate"]) for r in t["formats"].collect()} == {"a": (12.5, None), "b": (None, None), "c": (None, None)}


def test_tool_lines(spark):
    cases = [
        ("Bash", {"command": "ls -l\nrm x", "description": ""}, "ls -l"), ("mcp__x__Bash", {"command": "c", "description": "Lists"}, "Lists"), ("Read", {"file_path": "/a/b/c.py", "n": 1}, "c.py"), ("WebSearch", {"query": "q" * 200}, "q" * 100),
        ("WebFetch", {"url": "http://x"}, "http://x"), ("T", {"prompt": "p"}, "p"), ("T", {"query": "s", "a": 1}, "s"), ("T", {"l": [1], "big": "y" * 101, "n": 7}, "7"), ("T", {}, ""), ("T", "\n  first line \nsecond", "first line"), ("T", [1], ""),
    ]
    df = spark.createDataFrame([(i, n, x if isinstance(x, str) else json.dumps(x)) for i, (n, x, _) in enumerate(cases)], "i long, name string, given string")
    assert [r[0] for r in df.orderBy("i").select(tool_line(F.col("name"), F.col("given"))).collect()] == [c[2] for c in cases]


def test_search_answers(spark):
    rows = [
        (2, "links", {"organic": [{"link": "l1", "title": "", "snippet": None, "date": "2024"}, {"title": "none"}, {"link": "l2", "snippet": "s"}]}), (1, "texts", {"results": [{"url": "u", "text": "t", "publishedDate": "p"}]}),
        (3, "contents", {"results": [{"url": "v", "content": "c", "title": "T"}], "organic": [{"link": "no"}]}), (4, "links", None), (5, "texts", {}),
    ]
    df = spark.createDataFrame([(n, s, json.dumps(x) if x is not None else "broken") for n, s, x in rows], "query_no long, shape string, response string")
    got = sorted(tuple(r) for r in answered(df, first=5).collect())
    assert got == [(5, 1, "u", "N/A", "t", "p"), (6, 2, "l1", "N/A", "N/A", "2024"), (7, 2, "l2", "N/A", "s", "N/A"), (8, 3, "v", "T", "c", "N/A")]


def test_time_hits(spark):
    macros = spark.createDataFrame([("a", "s0", 0.0, 10.0), ("b", "gone", 600.0, 700.0), ("c", "s0", 601.0, 700.0), ("d", None, -5.0, 0.0)], "macro_id string, super_id string, t_start double, t_end double")
    supers = spark.createDataFrame([("s0", "First")], "super_id string, label string")
    assert {r["macro_id"]: r["super_event"] for r in time_hits(macros, supers).collect()} == {"a": "First", "b": "", "d": ""}
