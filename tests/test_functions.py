"""Column functions and folds against stated values."""

import json

import pytest
from pyspark.sql import functions as F

from mnemograph.functions import media, text, timeexpr
from mnemograph.operators import index, merge, preview, segment, trace


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f,arg,want",
    [
        (timeexpr.parse_build, "01:01:01.5", 3661.5), (timeexpr.parse_build, "02:30.25", 150.25), (timeexpr.parse_build, "x", None),
        (timeexpr.parse_shared, "12.5s", 12.5), (timeexpr.parse_shared, "1:2:3:4", None),
        (timeexpr.parse_item, "day2_00:00:05", 100005.0), (timeexpr.parse_item, "DAY1 10:00:00", 36000.0), (timeexpr.parse_item, "day2 10:00:00", 36000.0), (timeexpr.parse_item, "zz", 0.0), (timeexpr.parse_item, "7.5", 7.5),
        (timeexpr.parse_day_argument, "DAY2 0:00:05 and", 100005.0), (timeexpr.parse_day_argument, "day2 00:00:05", None),
        (timeexpr.parse_plain, "at_01:00:00", 3600.0), (timeexpr.parse_plain, "none", None),
        (timeexpr.parse_day_based, "day3 00:00:01", 200001.0), (timeexpr.parse_day_based, "00:00:01", None),
        (text.size_bytes, "15 MiB", 15 << 20), (text.size_bytes, "2kb", 2000), (text.size_bytes, "x", None),
        (media.rate, "30000/1001", 30000 / 1001), (media.rate, "0/0", 0.0), (media.bitrate_text, "2500000", "2.50 Mb/s"),
        (text.redacted, "see /a/b/c.png", "see /path/to/c.png"), (text.short_tool, "mcp__x__read", "read"),
        (merge.short_key, "P12_abc", "P12"), (merge.short_key, "film_a_b", "film"),
    ],
)
def test_scalars(spark, f, arg, want):
    got = value(spark, f(F.lit(arg)))
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_clocks(spark):
    assert value(spark, timeexpr.hms(F.lit(59.9))) == "00:00:59"
    assert value(spark, timeexpr.day_hms(F.lit(100061.0))) == "DAY2 00:01:01"
    assert value(spark, timeexpr.srt_time(F.lit(3_723_004))) == "01:02:03,004"
    assert value(spark, timeexpr.scaled(F.lit(75.5), F.lit(100.0))) == "1:15.5"
    assert value(spark, media.duration_text(F.lit(0.0))) == "unknown duration"


def test_halves_go_to_the_even_digit(spark):
    """780,271,616 bytes are 744.125 MiB, which was shown as 744.13."""
    cases = [(media.size_text, str(n)) for n in (780_271_616, 780_271_616 + 262_144, 780_271_617, 2**30 + 2**27, 1)] + [(media.duration_text, x) for x in (0.25, 0.75, 60.125, 3600.375, 7.1)] + [(media.bitrate_text, x) for x in ("2500", "3500", "1125000")]
    mib, clock = lambda b: f"{b / 2**30:.2f} GiB" if b >= 2**30 else f"{b / 2**20:.2f} MiB", lambda x: f"{int(x // 3600)}:{int(x % 3600 // 60):02d}" if x >= 3600 else f"{int(x // 60)}"
    want = [mib(int(x)) for _, x in cases[:5]] + [f"{clock(x)}:{x % 60:04.1f} ({x:.2f}s)" for _, x in cases[5:10]] + ["2 kb/s", "4 kb/s", "1.12 Mb/s"]
    assert [value(spark, f(F.lit(x))) for f, x in cases] == want
    assert [value(spark, timeexpr.scaled(F.lit(x), F.lit(y))) for x, y in ((0.25, 1.0), (60.75, 60.0))] == ["0.2s", "1:00.8"]


def test_tokens(spark):
    assert value(spark, text.tokens(F.lit("The Été of 知识图谱 a b1 是"))) == ["été", "知识图谱", "b1"]


@pytest.mark.parametrize("answer,want", [('{"a": 1}', '{"a": 1}'), ('<think>{x}</think>Sure: {"a": [1]} ok', '{"a": [1]}'), ('```json\n[1, 2]\n```', "[1, 2]"), ("none", None)])
def test_model_json(spark, answer, want):
    assert value(spark, text.model_json(F.lit(answer))) == want


def test_model_json_repair(spark):
    assert json.loads(value(spark, text.model_json(F.lit('{"a": [1, 2,], }'), repair=True))) == {"a": [1, 2]}


def test_grounding(spark):
    got = value(spark, text.grounding(F.lit('[{"label": "cat", "bbox_2d": [0, 0, 500, 750]}]'), F.lit(96), F.lit(64)))
    assert [(g["label"], g["bbox"]) for g in got] == [("cat", [0, 0, 48, 48])]


def plain_pack(t, most=500):
    import re

    parts = [s.strip() for s in re.split(r"(?<=[.!?。！？\n])", t)]
    out, cur = [], ""
    for s in filter(None, parts):
        if cur and len(cur) + len(s) > most:
            out.append(cur)
            cur = s
        else:
            cur = f"{cur} {s}" if cur else s
    return out + [cur] * bool(cur)


def test_packing_of_sentences(spark):
    for t in ("", "Hi.", " ".join(f"Sentence number {i} has some words." for i in range(90)), "x" * 1200 + ". Short! 好。"):
        assert value(spark, text.packed_sentences(F.lit(t))) == plain_pack(t)


def test_transcript_nodes(spark):
    df = spark.createDataFrame([("m0", "Hello there. All fine."), ("m1", "hi"), ("m2", None)], "macro_id string, asr_text string")
    assert [r["node_id"] for r in merge.transcript_nodes(df).collect()] == ["asr_m0_000"]


def test_scenes(spark):
    kept = F.array(*(F.lit(float(x)) for x in (30, 200)))
    got = value(spark, segment.scenes(kept, F.lit(0.0), F.lit(205.0), 20.0, 100.0))
    assert [(g["t_start"], g["t_end"]) for g in got] == [(0.0, 30.0), (30.0, 115.0), (115.0, 205.0)]
    none = F.array().cast("array<double>")
    assert [(g["t_start"], g["t_end"]) for g in value(spark, segment.scenes(none, F.lit(0.0), F.lit(50.0), 20.0, 100.0))] == [(0.0, 50.0)]


def test_threshold(spark):
    rows = [("a", 10.0, 1.0), ("a", 20.0, 5.0), ("a", 30.0, 1.0), ("b", 5.0, None), ("c", 1.0, 9.0), ("d", 10.0, 4.0), ("d", 20.0, 1.0), ("d", 30.0, 2.0), ("d", 40.0, 3.0), ("d", 60.0, 4.0)]
    cuts = spark.createDataFrame(rows, "v string, t double, score double")
    got = dict(segment.thresholds(cuts, "v", 0, 70, 5, 15).collect())
    # d: level 2 gives lengths 10, 10, 10, 20, 20 and is met first; its upper median is the goal itself
    assert got == {"a": 1.0, "b": 27.0, "c": 9.0, "d": 2.0}
    assert segment.thresholds(cuts.limit(0), "v", 0, 70, 5, 15).count() == 0


def test_ancestors_end_in_cycles(spark):
    rows = [("a", None, True), ("b", "a", False), ("c", "b", False), ("x", "y", False), ("y", "x", False), ("z", "gone", False)]
    got = dict(trace.user_ancestors(spark.createDataFrame(rows, "id string, parent string, is_user boolean"), 8).collect())
    assert got == {"a": "a", "b": "a", "c": "a", "x": None, "y": None, "z": None}


def test_search_toy(spark):
    nodes = spark.createDataFrame([("n0", "event", "orange cat"), ("n1", "event", "blue dog"), ("n2", "entity", "red car")], "node_id string, node_type string, text string")
    hits = index.fuse(None, index.bm25(nodes, "orange cat")).collect()
    assert [r["node_id"] for r in hits] == ["n0"]
    assert not index.bm25(nodes, "the").count()


def test_pages_and_samples(spark):
    assert value(spark, text.page_indices(F.lit("1,3,5-8"), F.lit(6))) == [0, 2, 4, 5]
    assert value(spark, text.page_indices(F.lit("bad"), F.lit(30))) == list(range(20))
    assert value(spark, preview.even_positions(F.lit(10), 4)) == [0, 3, 6, 9]


def test_resize(spark):
    got = value(spark, media.resized(F.lit(1000), F.lit(1000), F.lit(1024), F.lit(250_000)))
    assert (got["height"], got["width"]) == (512, 512)


def test_texts_for_voices_and_models(spark):
    from mnemograph.functions import text

    df = spark.createDataFrame([("好。(再)见！ 完", '[{"name": "a"}, "b", {"type": "x"}]', '{"results": [1, 2]}', "slot3_e_1", "later")], "t string, names string, answer string, id string, at string")
    r = df.select(
        text.spoken_sentences(text.speakable(F.col("t"))).alias("s"), text.names_of(F.col("names")).alias("n"), text.stated_count(F.col("answer")).alias("c"),
        text.own_id(F.col("id")).alias("id"), text.kept_time(F.lit(None).cast("double"), F.col("at")).alias("at"),
    ).first()
    assert r["s"] == ["好。", "再见！", "完"] and r["n"] == ["a", "b", ""] and r["c"] == 2 and r["id"] == "e_1" and tuple(r["at"]) == (None, "later")


def test_intersection_and_degenerate_points(spark):
    from mnemograph.functions import geometry as g

    p = lambda x, y: g.point(F.lit(x), F.lit(y))
    r = spark.range(1).select(
        g.intersection(p(5, 5), p(0, 0), p(10, 10), p(0, 10), p(10, 0)).alias("a"), g.intersection(p(5, 5), p(0, 0), p(1, 1), p(2, 0), p(3, 1)).alias("b"),
        g.collinear(p(1, 1), p(1, 1), p(1, 1)).alias("c"), g.parallel(p(1, 1), p(1, 1), p(0, 0), p(1, 0)).alias("d"), g.ratio(p(0, 0), p(3, 4), p(0, 0), p(0, 10), F.lit(0.5)).alias("e"),
    ).first()
    assert tuple(r) == (True, False, True, False, True)


def test_digest_summary_and_segment_times(spark):
    from mnemograph.operators import graph

    sub = spark.sql(
        """SELECT transform(sequence(1, 12), i -> named_struct('entity_id', concat('e', i), 'name', if(i = 1, '', concat('n', i)), 'entity_type', 'T')) AS en,
        array(named_struct('event_type', 'b'), named_struct('event_type', ''), named_struct('event_type', 'a'), named_struct('event_type', 'b')) AS ev, array(named_struct('text', 'x')) AS sc"""
    )
    d = sub.select(graph.macro_digest(F.col("en"), F.col("ev"), F.col("sc")).alias("d")).first()["d"]
    assert [e["name"] for e in d["key_entities"]][:2] == ["e1", "n2"] and len(d["key_entities"]) == 10 and d["event_types"] == ["a", "b"] and d["ocr_texts"] == ["x"]
    roots = spark.sql("SELECT 'v' AS video_key, 't' AS title, 'd' AS description, array('x') AS themes, array('y') AS key_entities, CAST(NULL AS STRING) AS emotional_tone")
    assert '"emotional_tone" : null' in graph.summary(roots).first()["json"]
    assert spark.range(1).select(graph.absolute(F.array(F.lit(1.0), F.lit(2.5)), F.lit(10.0)).alias("t")).first()["t"] == [11.0, 12.5]
