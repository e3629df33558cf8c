"""Joins that must take every row of their tables, on small fixtures."""

from mnemograph.plans.queries import QUERIES


def test_every_turn_meets_a_macro(spark, tmp_path):
    """Conversations of any id and length: those from 40 up and turns past 300 s were lost before."""
    rows = [(c, t, "user" if t % 2 else "system", "x") for c, n in ((0, 2), (39, 1), (40, 3), (5000, 45)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["macro_id"]: r["asr_text"] for r in QUERIES["conversation_overlap_merge"](spark, str(tmp_path)).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = [(t * 10 + c % 7, f"{role}-{t}") for x, t, role, _ in rows if x == c]
        for i in range(-(-(max(a for a, _ in own) + 10) // 15)):
            want[f"m{c}_{i}"] = " ".join(t for a, t in sorted(own) if a < i * 15 + 15 and a + 10 > i * 15)
    assert got == want
    assert all(any(f"{role}-{t}" in v.split() for k, v in got.items() if k.startswith(f"m{c}_")) for c, t, role, _ in rows)


def test_every_user_day_is_compared(spark):
    """Users of any number, touching and equal ranges, turned-round and null ones."""
    import random

    from mnemograph.operators.interval import overlap_counts

    rng = random.Random(5)
    rows = []
    for k in range(120):
        day, a = k % 3, rng.randint(0, 40)
        rows.append((f"r{k}", day, 100.0 * day + a, 100.0 * day + a + rng.choice((0, 1, 5, 30))))
    want = {i: sum(d == e and a <= y and b >= x for _, e, x, y in rows) - 1 for i, d, a, b in rows}
    odd = [("turned", 1, 130.0, 120.0), ("none", 1, None, 120.0), ("no key", None, 100.0, 120.0)]
    df = spark.createDataFrame(rows + odd, "macro_id string, day long, t_start double, t_end double").repartition(5)
    assert {r["macro_id"]: r["n_overlaps"] for r in overlap_counts(df, "macro_id", "t_start", "t_end", "day").collect()} == want
    assert max(want.values()) > 3 and overlap_counts(df.limit(0), "macro_id", "t_start", "t_end", "day").count() == 0


def test_overlap_counts_take_all_users(spark, tmp_path):
    """Users 1 and 2 of each hundred alone were compared before."""
    spark.sql("SELECT id AS user_id, TIMESTAMP_NTZ'2024-01-02 10:00:00' AS ts FROM range(7)").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["macro_id"]: r["n_overlaps"] for r in QUERIES["overlap_counts"](spark, str(tmp_path)).collect()}
    assert got == {f"u_{k}_1": 6 for k in range(7)}


def test_every_turn_has_a_vtt_cue(spark, tmp_path):
    """Turns from 9 on were lost before, and a conversation of none but such had no file."""
    import duckdb

    from mnemograph.plans import file_queries  # noqa: F401  (registers its queries)
    from mnemograph.plans.queries import SQL

    turns = [(c, t) for c, own in ((0, range(3)), (7, range(401)), (12, range(9, 20)), (13, [0, 8, 9, None])) for t in own]
    spark.createDataFrame([(c, t, "user", f" turn  {t}\nof --> {c} ") for c, t in turns], "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in QUERIES["vtt_files"](spark, str(tmp_path)).select("conv_id", "cue", "time", "text").collect())
    place = {c: [x for x in turns if x[0] == c] for c, _ in turns}
    assert got == sorted((c, place[c].index((c, t)), None if t is None else f"00:0{t}.000 --> 00:0{t + 1}.500", f"turn {t} of --> {c}") for c, t in turns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(con.execute(f"SELECT conv_id, cue, time, text FROM ({SQL['vtt_files']})").fetchall())
