"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.llm.alignment import align_tokens
from mnemograph.llm.collocations import mine_phrases
from mnemograph.llm.decontaminate import decontaminate
from mnemograph.llm.jaccard_join import jaccard_components
from mnemograph.llm.lm_scoring import lm_score
from mnemograph.llm.packing import pack
from mnemograph.llm.pii import IBAN, KNOWN_KEYS, pii_report
from mnemograph.llm.quality import score_quality
from mnemograph.llm.suffix_dedup import dedup_suffixes
from mnemograph.llm.token_counts import count_tokens
from mnemograph.llm.token_orc import token_table
from mnemograph.llm.topk import top_k
from mnemograph.llm.url_filter import judge_urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(_read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(_read(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_read(spark, sf_dir, "documents"))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), with_ids=False)


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.col("n_items"), "items_sha256", "contaminated")


def op9_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_read(spark, sf_dir, "documents"))


#: The rules that op13's contract names.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op13_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(4, len(ws)) - 1], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 0) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) m USING (doc_id)
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT vec_id, min(e) AS e FROM v GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM one q JOIN one c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

def _pii_sql() -> str:
    """Per kind: the text between matches gives the positions, as in the operator."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": rf"\b(?:{IBAN})\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "secret": rf"\b(?:{KNOWN_KEYS}|[A-Fa-f0-9]{{32,64}})\b",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    back = f"string_split(reverse({digits}), '')"
    words = r"(?i)\b(?:token|secret|password|passwd|credential|key|api_?key|access_?key|auth)\b"
    codes = "list_transform(string_split(substr(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END)"
    rules = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0",
        "card": f"CASE WHEN len({digits}) BETWEEN 14 AND 19 THEN list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({back}[i] AS INTEGER) WHEN CAST({back}[i] AS INTEGER) < 5 THEN 2 * CAST({back}[i] AS INTEGER) ELSE 2 * CAST({back}[i] AS INTEGER) - 9 END)) % 10 = 0 ELSE false END",
        "phone": f"len({digits}) BETWEEN 10 AND 15",
        "iban": f"CASE WHEN len(replace(m, ' ', '')) BETWEEN 15 AND 34 THEN list_reduce(list_transform(string_split(array_to_string({codes}, ''), ''), lambda c: CAST(c AS INTEGER)), lambda a, c: (a * 10 + c) % 97) = 1 ELSE false END",
        "ssn": r"regexp_matches(before, '(?i)\b(?:ssn|social|security|insurance)\b') OR regexp_matches(after, '(?i)\b(?:ssn|social|security|insurance)\b')",
        "secret": f"regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND (regexp_matches(m, '^(?:{KNOWN_KEYS})$') OR regexp_matches(before, '{words}') OR regexp_matches(after, '{words}'))",
    }
    parts = []  # "after" starts with the match's right neighbour
    for n, (kind, pattern) in enumerate(patterns.items()):
        parts.append(
            f"SELECT doc_id, {n} AS kind_no, '{kind}' AS kind, s AS start, s + len(m) AS stop FROM (SELECT doc_id, g[i] AS m, right(p[i], 40) AS before, left(p[i + 1], 40) AS after, "
            f"CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(g[1 : i - 1], lambda x: len(x))), 0) AS BIGINT) AS s "
            f"FROM (SELECT doc_id, g, p, unnest(range(1, len(g) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS g, regexp_split_to_array(t, '{pattern}') AS p FROM d))) WHERE {rules[kind]}"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join(parts) + "), a AS (SELECT doc_id, "
        + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))
        + ", string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS spans FROM f GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"
    )


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM p),
dw AS (
  SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, lens WHERE len(ws) >= m)),
h AS (SELECT dw.doc_id, dw.i, dw.m, p.item_id FROM dw JOIN p ON dw.m = p.m AND dw.win = p.win),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP12_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM t),
g AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, range(1, 6) x(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
s AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
z AS (
  SELECT s.lang, s.phrase, a, k, x.f AS l, y.f AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM s JOIN f x ON x.lang = s.lang AND x.phrase = lp JOIN f y ON y.lang = s.lang AND y.phrase = rp JOIN n ON n.lang = s.lang),
w AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, array_to_string(ws[i : i + m - 2], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE m > 2) GROUP BY ALL),
k AS (SELECT w.* FROM w LEFT JOIN u ON u.lang = w.lang AND u.phrase = w.phrase WHERE longer IS NULL OR 100 * longer < 100 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000
"""


def _url_sql(least_good: float = 0.5, z: float = 1.645, strength: float = 10.0) -> str:
    """The levels' shares and strengths as in the operator."""

    def fits(h: str, p: str) -> str:
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"

    ranked = sorted(((v, *r.partition("/")) for v, r in URL_RULES), key=lambda r: -len(r[1] + r[3]))
    rule = " ".join(f"WHEN {fits(h, '/' + p)} THEN '{h}/{p}'" for _, h, _, p in ranked)
    by_rule = " ".join(f"WHEN {fits(h, '/' + p)} THEN '{v}'" for v, h, _, p in ranked)

    def prior(children: str, parent: str) -> str:
        return (
            f"(SELECT CASE WHEN coalesce(room, 0) <= 1e-9 THEN {strength} ELSE round(1 / least(greatest(over_ / room, 1 / 1001.0), 0.5) - 1, 6) END AS m FROM ("
            f"SELECT sum(ss - s * s / n - s / n * (1 - s / n) * (k - 1)) AS over_, sum(s / n * (1 - s / n) * (n - nn / n - (k - 1))) AS room FROM ("
            f"SELECT {parent} AS p, count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(s) AS DOUBLE) AS s, sum(CAST(n AS DOUBLE) * n) AS nn, sum(CAST(s AS DOUBLE) * s / n) AS ss FROM {children} WHERE n > 0 GROUP BY ALL)))"
        )

    return rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {rule} END AS rule, CASE {by_rule} END AS by_rule, regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g') AS bare FROM u),
h AS (
  SELECT bare, regexp_matches(bare, '^[0-9.]+$|[\[:]') AS address, CASE WHEN address THEN bare ELSE string_split(bare, '.')[-1] END AS suffix,
    CASE WHEN address THEN bare ELSE array_to_string(string_split(bare, '.')[-2:], '.') END AS domain, count(by_rule) AS n, count(*) FILTER (by_rule = 'allow') AS s FROM r GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM h GROUP BY ALL),
t AS (SELECT suffix, 0 AS everything, sum(n) AS n, sum(s) AS s FROM d GROUP BY ALL),
m AS (SELECT (sum(s) + 1) / CAST(sum(n) + 2 AS DOUBLE) AS mean FROM t),
mt AS {prior("t", "everything")}, md AS {prior("d", "suffix")}, mh AS {prior("h", "domain")},
ts AS (SELECT suffix, (mt.m * mean + s) / (mt.m + n) AS share FROM t, m, mt),
ds AS (SELECT domain, (md.m * ts.share + d.s) / (md.m + d.n) AS share FROM d JOIN ts USING (suffix), md),
hs AS (SELECT bare, mh.m * ds.share + h.s AS a, mh.m * (1 - ds.share) + (h.n - h.s) AS b FROM h JOIN ds USING (domain), mh),
b AS (SELECT bare, a / (a + b) + {z} * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) AS bound FROM hs)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN bound < {least_good} THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN b USING (bare)
"""


QUERIES = {
    f.__name__: f
    for f in (op1_jaccard_join, op2_token_orc, op3_token_counts, op4_suffix_dedup, op5_exact_topk, op6_pii, op7_harmonic_packing, op8_wu_manber, op9_ppm_scoring, op10_quality, op11_alignment, op12_collocations, op13_url_reputation)
}
ORACLE_SQL = {"op1_jaccard_join": OP1_SQL, "op5_exact_topk": OP5_SQL, "op6_pii": _pii_sql(), "op8_wu_manber": OP8_SQL, "op12_collocations": OP12_SQL, "op13_url_reputation": _url_sql()}
