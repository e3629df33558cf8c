"""Asset manifests, the subgraph store and chunks put together."""

from pyspark.sql import functions as F

from mnemograph.operators.merge import merged_chunks
from mnemograph.sources import memory
from mnemograph.sources.files import cache_key, manifest_changes, renderer, scan_assets


def test_assets_and_changes(spark, tmp_path):
    root = tmp_path / "my assets+"
    for name, text in {"sfx/a/boom.WAV": "x" * 2048, "sfx/a/boom.txt": "\n  by me \n" + "y" * 500, "sfx/no.png": "x", "images/p.png": "1", "other/q.png": "2", "clips/c.mp4": "3", "images/note.txt": "n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = {r["file"]: r for r in scan_assets(spark, str(root)).collect()}
    assert sorted(got) == ["clips/c.mp4", "images/p.png", "sfx/a/boom.WAV"]
    boom = got["sfx/a/boom.WAV"]
    assert tuple(boom[c] for c in ("bucket", "kind", "name", "ext", "size_kb")) == ("sfx", "audio", "boom", "wav", 2.0)
    assert boom["note"].startswith("by me \ny") and len(boom["note"]) == 400

    old = scan_assets(spark, str(root), hashed=True).where("file <> 'images/p.png'").withColumn("mood", F.lit("calm")).withColumn("duration", F.lit(2.5))
    old = spark.createDataFrame(old.unionByName(old.where("bucket = 'clips'").withColumn("file", F.lit("clips/gone.mp4"))).collect())
    (root / "clips/c.mp4").write_text("33")
    rows = {r["file"]: (r["state"], r["mood"], r["duration"]) for r in manifest_changes(scan_assets(spark, str(root), hashed=True), old).collect()}
    assert rows == {"clips/c.mp4": ("changed", "calm", None), "images/p.png": ("new", None, None), "sfx/a/boom.WAV": ("kept", "calm", 2.5), "clips/gone.mp4": ("gone", "calm", 2.5)}
    assert manifest_changes(scan_assets(spark, str(root), hashed=True), old.limit(0)).where("state = 'new'").count() == 3


def test_keys_and_readers(spark):
    df = spark.createDataFrame([("a.SRT", 1, 2), ("b", 1, 2)], "p string, m long, s long")
    got = df.select(renderer(F.col("p")).alias("r"), cache_key(F.col("p"), F.col("m"), F.col("s"), F.lit("w=1")).alias("k")).collect()
    assert [r["r"] for r in got] == ["subtitle", "text"]
    assert [len(r["k"]) for r in got] == [16, 16] and got[0]["k"] != got[1]["k"]


def test_one_macro_is_one_file(spark, tmp_path):
    rows = [(f"m{i % 500}", i, "x" * 20) for i in range(3000)]
    memory.write_subgraphs(spark.createDataFrame(rows, "macro_id string, n long, text string").repartition(6), str(tmp_path / "g"), buckets=16)
    assert len(list((tmp_path / "g").glob("bucket=*/*.parquet"))) == 16  # no folder a macro
    one = memory.read_subgraph(spark, str(tmp_path / "g"), "m77", buckets=16)
    assert sorted(r["n"] for r in one.collect()) == [77 + 500 * i for i in range(6)]
    assert one.select(F.input_file_name()).distinct().count() == 1
    plan = one._jdf.queryExecution().executedPlan()
    plan.execute().count()
    scan = plan
    while scan.children().size():
        scan = scan.children().head()
    assert scan.metrics().apply("numFiles").value() == 1
    assert memory.read_subgraph(spark, str(tmp_path / "g"), "none", buckets=16).count() == 0


def test_chunks_put_together(spark):
    graph = "struct<macro_id:string,micro_events:array<struct<event_id:string,macro_id:string>>,entities:array<struct<name:string,macro_id:string>>,edges:array<struct<source_id:string>>>"
    macros = [
        ("b", 0, "macro_0000", 30.0, ("macro_0000", [("e", "macro_0000")], None, [("e",)])), ("b", 1, "macro_0001", 10.0, None),
        ("a", 0, "macro_0000", 10.0, ("x", [], [("n", "y")], [])), ("a", 1, "macro_0001", 20.0, ("macro_0001", [("f", "z"), ("g", None)], [], None)),
    ]
    supers = [("a", "s0", ["macro_0001", "macro_0000", "macro_0001", "gone"]), ("b", "s0", ["macro_0000"]), ("b", "s1", [])]
    relations = [("a", "macro_0000", "macro_0001", "T"), ("b", "macro_0000", "gone", "T"), ("b", "macro_0001", "macro_0000", "U")]
    m, s, r = merged_chunks(
        spark.createDataFrame(macros, f"chunk string, pos long, macro_id string, t_start double, subgraph {graph}"), spark.createDataFrame(supers, "chunk string, super_id string, sub_macro_ids array<string>"),
        spark.createDataFrame(relations, "chunk string, source string, target string, type string"),
    )
    got = {x["macro_id"]: x["subgraph"] for x in m.collect()}
    assert sorted(got) == [f"macro_000{i}" for i in range(4)]
    assert got["macro_0001"] is None  # of b, at the same time as a's first
    assert got["macro_0003"]["macro_id"] == "macro_0003" and got["macro_0003"]["micro_events"][0]["macro_id"] == "macro_0003" and got["macro_0003"]["entities"] is None and got["macro_0003"]["edges"][0]["source_id"] == "e"
    assert got["macro_0000"]["entities"][0]["macro_id"] == "macro_0000"
    assert [e["macro_id"] for e in got["macro_0002"]["micro_events"]] == ["macro_0002"] * 2
    assert {(x["chunk"], x["super_id"]): x["sub_macro_ids"] for x in s.collect()} == {("a", "s0"): ["macro_0002", "macro_0000", "macro_0002"], ("b", "s0"): ["macro_0003"], ("b", "s1"): []}
    assert sorted((x["source"], x["target"], x["type"]) for x in r.collect()) == [("macro_0000", "macro_0002", "T"), ("macro_0001", "macro_0003", "U")]
