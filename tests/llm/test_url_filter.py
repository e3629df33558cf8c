"""URL filter against a plain version, with hosts that differ."""

import math
import random
from collections import defaultdict

import duckdb
import pytest

from mnemograph.llm.queries import ORACLE_SQL, URL_RULES
from mnemograph.llm.url_filter import STRENGTH, STRONGEST, WEAKEST, judge_urls

SCHEMA = "page_id long, url string, html string, host string, bound double, rows long"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain(urls, rules, outcomes=None, least_good=0.5, z=1.645):
    out, seen = [], []
    for i, u in enumerate(urls):
        host, path = parts(u)
        fit = [(len(r), v, r) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        _, verdict, rule = max(fit, default=(0, None, None))
        good = (None if verdict is None else verdict == "allow") if outcomes is None else outcomes.get(i)
        out.append([i, host, path, rule, verdict])
        seen.append((host, good))
    tables = [defaultdict(lambda: [0, 0]) for _ in range(4)]
    names = {}
    for host, good in seen:
        labels = host.split(".")
        names[host] = (host, ".".join(labels[-2:]), labels[-1], "")
        for table, name in zip(tables, names[host]):
            table[name][0] += good is not None
            table[name][1] += bool(good)
    up = [{} for _ in range(3)]
    for host, domain, suffix, top in names.values():
        up[0][host], up[1][domain], up[2][suffix] = domain, suffix, top

    def strength(children, parent_of):
        groups = defaultdict(list)
        for name, (n, s) in children.items():
            if n:
                groups[parent_of[name]].append((n, s))
        over = room = 0.0
        for g in groups.values():
            n, s = sum(x for x, _ in g), sum(x for _, x in g)
            p, k = s / n, len(g)
            over += sum(y * y / x for x, y in g) - s * s / n - p * (1 - p) * (k - 1)
            room += p * (1 - p) * (n - sum(x * x for x, _ in g) / n - (k - 1))
        return STRENGTH if room <= 1e-9 else 1 / min(max(over / room, 1 / (STRONGEST + 1)), 1 / (WEAKEST + 1)) - 1

    m = [strength(tables[i], up[i]) for i in range(3)]
    n, s = tables[3][""]
    share = {("", 3): (s + 1) / (n + 2)}
    for level in (2, 1):
        for name, (n, s) in tables[level].items():
            share[name, level] = (m[level] * share[up[level][name], level + 1] + s) / (m[level] + n)
    for row in out:
        if row[4] is None:
            n, s = tables[0][row[1]]
            prior = share[up[0][row[1]], 1]
            a, b = m[0] * prior + s, m[0] * (1 - prior) + n - s
            bound = a / (a + b) + z * math.sqrt(a * b / (a + b) ** 2 / (a + b + 1))
            row[4] = "block" if bound < least_good else "allow"
    return [tuple(r) for r in out]


def urls():
    rng = random.Random(5)
    out = [None, "", "no address", "http://", "http://A.Example.ORG", "http://example.org/es/x?y=/en/1", "https://notexample.org/es/1", "ftp://m.Example.org/en/12#a", "http://É.org/ü/", "x://y.com/fr/://z.org/", "http://com/de/", "http://b.com?/de/", "http://b.com/DE/", "a\nb://c.com/de/\nx?z"]
    for i in range(600):
        host = "hot.example.com" if i % 3 == 0 else f"h{i % 17}.d{i % 5}.{('com', 'org', 'net')[i % 3]}"
        out.append(f"http://{host}/{rng.choice(['de', 'fr', 'en', 'es'] if i % 17 else ['de', 'de', 'de', 'en'])}/{i}")
    return out + out[20:30]


@pytest.mark.parametrize("given", [False, True])
def test_verdicts(spark, given):
    rows = urls()
    rng = random.Random(2)
    outcomes = {i: rng.random() < (0.05 if "h3." in (u or "") or "hot" in (u or "") else 0.9) for i, u in enumerate(rows) if i % 4} if given else None
    df = spark.createDataFrame([(i, u, "<p>", "x", 1.0, 2) for i, u in enumerate(rows)], SCHEMA).repartition(5)
    known = spark.createDataFrame(list(outcomes.items()), "page_id long, good boolean") if given else None
    got = judge_urls(df, URL_RULES, known).select("page_id", "host", "path", "rule", "verdict").collect()
    want = plain(rows, URL_RULES, outcomes)
    assert sorted(map(tuple, got)) == sorted(want)
    by_method = {r[4] for r in want if r[3] is None}
    assert by_method == ({"allow", "block"} if given else {"allow"})


def test_sql_says_the_same(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "<p>", "x", 1.0, 2) for i, u in enumerate(urls())], SCHEMA)
    df.select("page_id", "url").toPandas().to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = con.execute(ORACLE_SQL["op13_url_reputation"]).fetchall()
    got = judge_urls(df, URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_rules_longest_wins_and_odd_tables(spark):
    df = spark.createDataFrame([(1, "http://a.b.c/xy/z", None, None, None, None), (None, "http://b.c/xy", None, None, None, None), (1, "http://q.c/", None, None, None, None)], SCHEMA)
    rules = [("allow", "c/"), ("block", "b.c/xy"), ("allow", "a.b.c/"), ("block", "a.b.c/xy/z")]
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in judge_urls(df, rules).collect()}
    assert got == {(1, "a.b.c/xy/z", "block"), (None, "b.c/xy", "block"), (1, "c/", "allow")}
    assert judge_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(df, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        judge_urls(df, [("deny", "c/")])


def test_suffixes_and_addresses(spark):
    from pyspark.sql import functions as F

    from mnemograph.llm.url_filter import levels

    hosts = ["u@a.b.co.uk:80", "co.uk", "10.0.0.1", "[::1]:8080", "x.com.", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [tuple(r) for r in df.select(*levels(F.col("host"), ["co.uk"])).collect()]
    assert got == [("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("10.0.0.1",) * 3, ("[::1]",) * 3, ("x.com", "x.com", "com"), ("",) * 3]
