"""One query for each operator over the standard tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.functions import geometry, media, text, timeexpr
from mnemograph.operators import graph, index, interval, layout, merge, preview, segment, signal, stored_index, trace
from mnemograph.operators.rank import global_rank, running_count
from mnemograph.session import work_path

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: They occur in the tables of every size, one of them rarely.
WORDS = "erth eror only of license thing ernd"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds(c: str = "ts") -> Column:
    """Seconds since 2024-01-01 of a time without zone."""
    return (F.unix_timestamp(F.date_trunc("second", F.col(c).cast("timestamp"))) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))).cast("double")


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """Macros: a user's day of events, from its first to its last second."""
    ev = read(spark, sf, "events").withColumn("s", seconds())
    return ev.groupBy("user_id", F.floor(F.col("s") / 86400).alias("day")).agg(F.min("s").alias("t_start"), F.max("s").alias("t_end"), F.count("*").alias("n_events")).select(
        F.concat_ws("_", F.lit("u"), "user_id", "day").alias("macro_id"), "user_id", "day", "t_start", "t_end", "n_events"
    )


EV = "ev AS (SELECT *, CAST(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01') AS DOUBLE) AS s FROM events)"
UD = EV + ", ud AS (SELECT 'u_' || user_id || '_' || CAST(floor(s / 86400) AS BIGINT) AS macro_id, user_id, CAST(floor(s / 86400) AS BIGINT) AS day, min(s) AS t_start, max(s) AS t_end, count(*) AS n_events FROM ev GROUP BY ALL)"


@query(f"WITH {UD} SELECT macro_id, user_id, t_start, t_end, n_events FROM ud WHERE t_start <= 200000 AND t_end >= 100000 AND t_start < 190000")
def search_by_time(spark, sf):
    return interval.at_times(user_days(spark, sf), 100_000, 200_000, cutoff=190_000).select("macro_id", "user_id", "t_start", "t_end", "n_events")


TOK = (
    "tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_]+'), lambda t: len(t) > 1 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in text.STOPWORDS)
    + "], t)) AS w FROM documents)"
)


def bm25_sql(query: str) -> str:
    q = " UNION ALL ".join(f"SELECT '{t}' AS term, {n} AS times" for t, n in index.query_terms(query).items())
    return (
        f"{TOK}, q AS ({q}), d AS (SELECT doc_id, len(w) AS dl, w FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), "
        "tf AS (SELECT doc_id, dl, term, times, len(list_filter(w, lambda x: x = term)) AS tf FROM d, q), df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term), "
        "bm AS (SELECT doc_id AS node_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY doc_id)"
    )


def nodes_of(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.col("lang").alias("node_type"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"WITH {bm25_sql(WORDS)} SELECT node_id, round(bm25, 6) AS bm25 FROM bm ORDER BY bm25 DESC, node_id LIMIT 20")
def bm25_topk(spark, sf):
    return index.top(index.bm25(nodes_of(spark, sf), WORDS).withColumn("bm25", F.round("bm25", 6)), 20, "bm25")


ASKED = "SELECT item_id AS query_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), ' ') AS query FROM benchmark"
BATCH_SQL = (
    f"WITH {TOK}, d AS (SELECT doc_id, len(w) AS dl, w FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), a AS ({ASKED}), "
    "q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter(string_split(query, ' '), lambda t: len(t) > 1 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in text.STOPWORDS)
    + "], t))) AS term FROM a) GROUP BY ALL), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), "
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "bm AS (SELECT query_id, doc_id AS node_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL) "
    "SELECT query_id, CAST(rank AS INTEGER) AS rank, node_id, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, node_id) AS rank FROM bm) WHERE rank <= 10"
)


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf: str) -> str:
    """The folder of an index over all documents, the later half added to the first; built once an application."""
    key = spark.sparkContext.applicationId, sf
    if key not in _stored:
        path, nodes = work_path(spark, "index"), nodes_of(spark, sf)
        middle = nodes.agg(F.max("node_id").alias("m")).first()["m"] or 0
        late = F.coalesce(F.col("node_id") > middle // 2, F.lit(False))
        stored_index.append(nodes.where(~late), path)
        stored_index.append(nodes.where(late), path)
        _stored[key] = path
    return _stored[key]


@query(BATCH_SQL)
def bm25_batch(spark, sf):
    """A query of each benchmark item, all its words, against all documents, by the stored index."""
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return stored_index.search_many(spark, stored(spark, sf), asked, 10, digits=6)


@query(f"WITH {bm25_sql(WORDS)} SELECT node_id, round(bm25, 6) AS bm25 FROM bm ORDER BY bm25 DESC, node_id LIMIT 20")
def stored_bm25_topk(spark, sf):
    """The same search by the stored index, of two segments."""
    return stored_index.search(spark, stored(spark, sf), WORDS, 20, digits=6)


@query(f"WITH {bm25_sql('license only')} SELECT node_id, round(bm25, 6) AS bm25 FROM bm JOIN documents ON doc_id = node_id WHERE lower(lang) IN ('fr', 'de') ORDER BY bm25 DESC, node_id LIMIT 15")
def stored_search_typed(spark, sf):
    return stored_index.search(spark, stored(spark, sf), "license only", 15, node_types=["FR", "De"], digits=6)


@query(f"WITH {TOK} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL) GROUP BY term")
def stored_term_statistics(spark, sf):
    """Statistics of the stored index, right after a segment was added."""
    return stored_index.term_statistics(spark, stored(spark, sf))


@query(f"WITH {bm25_sql(WORDS)} SELECT node_id, round(bm25, 6) AS bm25 FROM bm JOIN documents ON doc_id = node_id WHERE lower(lang) IN ('en', 'de') ORDER BY bm25 DESC, node_id LIMIT 20")
def search_typed(spark, sf):
    """Types are asked in any case and taken out before ranking; document frequencies are of all nodes."""
    scored = index.bm25(nodes_of(spark, sf), WORDS, node_types=["EN", "De"])
    return index.top(scored.withColumn("bm25", F.round("bm25", 6)), 20, "bm25")


@query(f"WITH {TOK} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL) GROUP BY term")
def term_statistics(spark, sf):
    return index.postings(nodes_of(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def vectors(spark, sf) -> tuple[DataFrame, list[float]]:
    v = read(spark, sf, "embeddings")
    first = v.where("vec_id = 0").first()
    return v, list(first["embedding"]) if first and first["embedding"] else [0.0]


COS = "cs AS (SELECT e.vec_id AS node_id, list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"WITH {COS} SELECT node_id, round(cosine, 6) AS cosine FROM cs ORDER BY cosine DESC, node_id LIMIT 20")
def cosine_topk(spark, sf):
    v, q = vectors(spark, sf)
    return index.top(index.cosine(v, q, "vec_id").withColumn("cosine", F.round("cosine", 6)), 20, "cosine")


RRF_SQL = (
    f"WITH {bm25_sql(WORDS)}, {COS}, a AS (SELECT *, row_number() OVER (ORDER BY round(cosine, 9) DESC, node_id) - 1 AS r FROM cs), b AS (SELECT *, row_number() OVER (ORDER BY round(bm25, 9) DESC, node_id) - 1 AS r FROM bm WHERE bm25 > 0) "
    "SELECT node_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 9) AS score, round(coalesce(cosine, 0), 4) AS cosine FROM a FULL JOIN b USING (node_id) ORDER BY score DESC, node_id LIMIT 20"
)


@query(RRF_SQL)
def hybrid_rrf(spark, sf):
    v, q = vectors(spark, sf)
    dense = index.cosine(v, q, "vec_id").withColumn("cosine", F.round("cosine", 9))
    sparse = index.bm25(nodes_of(spark, sf), WORDS).withColumn("bm25", F.round("bm25", 9))
    fused = index.fused_top(dense, sparse, 20).withColumn("score", F.round("score", 9))
    return index.top(fused, 20).withColumn("cosine", F.round("cosine", 4))


#: A start time for every node that doesn't depend on the table's size: half of them lie before the cutoff.
START, NOON = "node_id * 7919 % 86400", 43_200


@query(f"WITH {COS}, h AS (SELECT * FROM cs ORDER BY cosine DESC, node_id LIMIT 360) SELECT node_id, round(cosine, 4) AS cosine FROM (SELECT * FROM h WHERE round(cosine, 4) >= 0.1 AND {START} < {NOON} ORDER BY round(cosine, 4) DESC, node_id LIMIT 120)")
def enumerate_threshold(spark, sf):
    v, q = vectors(spark, sf)
    hits = index.cosine(v, q, "vec_id").withColumn("t_start", F.expr(START).cast("double"))
    return index.enumerated(hits, 0.1, F.col("t_start") < NOON).select("node_id", "cosine")


@query(f"WITH {bm25_sql(WORDS)}, o AS (SELECT node_id, round(bm25, 6) AS bm25 FROM bm ORDER BY bm25 DESC, node_id LIMIT 40) SELECT * FROM o WHERE {START} < {NOON} ORDER BY bm25 DESC, node_id LIMIT 20")
def overfetch_cutoff(spark, sf):
    scored = index.bm25(nodes_of(spark, sf), WORDS).withColumn("bm25", F.round("bm25", 6))
    return index.overfetched(scored, F.expr(START) < NOON, 20, "bm25")


@query("WITH s AS (SELECT doc_id AS node_id, " + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INTEGER)" for w in WORDS.split()) + " AS score FROM documents) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, node_id LIMIT 25")
def lexical_fallback(spark, sf):
    scored = nodes_of(spark, sf).select("node_id", text.lexical_score(F.col("text"), WORDS).alias("score")).where("score > 0")
    return index.top(scored, 25)


SEG = "seg AS (SELECT conv_id, turn * 10.0 + conv_id % 7 AS a, turn * 10.0 + conv_id % 7 + 10.0 AS b, role || conv_id || '-' || turn AS t FROM conversations), mac AS (SELECT conv_id, unnest(range(0, CAST(floor(max(b) / 20) AS BIGINT) + 1)) AS i FROM seg GROUP BY conv_id)"


@query(f"WITH {SEG} SELECT 'g' || mac.conv_id || '_' || i AS macro_id, coalesce(string_agg(t, ' ' ORDER BY a, b, t), '') AS asr_text FROM mac LEFT JOIN seg ON seg.conv_id = mac.conv_id AND a < i * 20.0 + 15.0 AND b > i * 20.0 + 5.0 GROUP BY mac.conv_id, i")
def asr_overlap_merge(spark, sf):
    """Every turn against macros with gaps: of each 20 s of a conversation the 10 s from its fifth second on."""
    a = F.col("turn") * 10.0 + F.col("conv_id") % 7
    segs = read(spark, sf, "conversations").select("conv_id", a.alias("start_sec"), (a + 10.0).alias("end_sec"), F.concat("role", F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("text"))
    ranges = segs.groupBy("conv_id").agg(F.floor(F.max("end_sec") / 20).alias("n")).where("n >= 0").select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("i"))
    macros = ranges.select(F.concat(F.lit("g"), F.col("conv_id").cast("string"), F.lit("_"), F.col("i").cast("string")).alias("macro_id"), "conv_id", (F.col("i") * 20.0 + 5.0).alias("t_start"), (F.col("i") * 20.0 + 15.0).alias("t_end"))
    return interval.transcript_texts(macros, segs, keys=("conv_id",))


CONV = "sg AS (SELECT conv_id, turn * 10.0 + conv_id % 7 AS a, turn * 10.0 + conv_id % 7 + 10.0 AS b, role || '-' || turn AS t FROM conversations), mc AS (SELECT conv_id, unnest(range(0, CAST(ceil(max(b) / 15) AS BIGINT))) AS i FROM sg GROUP BY conv_id)"


@query(f"WITH {CONV} SELECT 'm' || mc.conv_id || '_' || i AS macro_id, coalesce(string_agg(t, ' ' ORDER BY a, b, t), '') AS asr_text FROM mc LEFT JOIN sg ON sg.conv_id = mc.conv_id AND a < i * 15.0 + 15.0 AND b > i * 15.0 GROUP BY mc.conv_id, i")
def conversation_overlap_merge(spark, sf):
    """The transcript join over every turn: each conversation has macros of 15 s up to its last turn."""
    a = F.col("turn") * 10.0 + F.col("conv_id") % 7
    segs = read(spark, sf, "conversations").select("conv_id", a.alias("start_sec"), (a + 10.0).alias("end_sec"), F.concat("role", F.lit("-"), F.col("turn").cast("string")).alias("text"))
    ranges = segs.groupBy("conv_id").agg(F.ceil(F.max("end_sec") / 15).alias("n")).where("n > 0").select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    macros = ranges.select(F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("_"), F.col("i").cast("string")).alias("macro_id"), "conv_id", (F.col("i") * 15.0).alias("t_start"), (F.col("i") * 15.0 + 15.0).alias("t_end"))
    return interval.transcript_texts(macros, segs, keys=("conv_id",))


UT = EV + ", ut AS (SELECT user_id, CAST(floor(s / 86400) AS BIGINT) AS day, event_type AS k, min(s) AS x, max(s) AS y FROM ev GROUP BY ALL)"


@query(f"WITH {UT} SELECT a.user_id, a.day, a.k AS a_type, b.k AS b_type FROM ut a JOIN ut b ON a.user_id = b.user_id AND a.day = b.day AND a.k < b.k AND a.x <= b.y AND a.y >= b.x")
def overlap_pairs(spark, sf):
    """Of each user's day the kinds of events whose times, first to last, overlap."""
    ev = read(spark, sf, "events").withColumn("s", seconds())
    ranges = ev.groupBy("user_id", F.floor(F.col("s") / 86400).alias("day"), "event_type").agg(F.min("s").alias("x"), F.max("s").alias("y"))
    side = lambda n: ranges.select("user_id", "day", F.col("event_type").alias(f"{n}_type"), F.col("x").alias(f"{n}0"), F.col("y").alias(f"{n}1"))
    pairs = interval.overlap_join(side("a"), side("b"), ("a0", "a1"), ("b0", "b1"), 14_400.0, closed=True, keys=("user_id", "day"))
    return pairs.where("a_type < b_type").select("user_id", "day", "a_type", "b_type")


@query(f"WITH {UD} SELECT a.macro_id, count(*) - 1 AS n_overlaps FROM ud a JOIN ud b ON a.day = b.day AND a.t_start <= b.t_end AND a.t_end >= b.t_start GROUP BY a.macro_id")
def overlap_counts(spark, sf):
    """How many other user-days each user-day overlaps, over all users."""
    return interval.overlap_counts(user_days(spark, sf), "macro_id", "t_start", "t_end", "day")


ED = "ed AS (SELECT 'o' || l_orderkey AS s, 'p' || l_partkey AS t, 'HAS_PART' AS l FROM lineitem UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey, 'FROM_SUPPLIER' FROM lineitem), nd AS (SELECT 'p' || p_partkey AS id, 'part' AS k, p_name AS name FROM part UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'order', '' FROM orders)"


def order_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    li = read(spark, sf, "lineitem")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = li.select(key("o", "l_orderkey").alias("source_id"), key("p", "l_partkey").alias("target_id"), F.lit("HAS_PART").alias("relation_label")).unionByName(
        li.select(key("o", "l_orderkey").alias("source_id"), key("s", "l_suppkey").alias("target_id"), F.lit("FROM_SUPPLIER").alias("relation_label"))
    )
    nodes = read(spark, sf, "part").select(key("p", "p_partkey").alias("node_id"), F.lit("part").alias("node_type"), F.col("p_name").alias("label"))
    nodes = nodes.unionByName(read(spark, sf, "supplier").select(key("s", "s_suppkey").alias("node_id"), F.lit("supplier").alias("node_type"), F.col("s_name").alias("label")))
    return edges, nodes.unionByName(read(spark, sf, "orders").select(key("o", "o_orderkey").alias("node_id"), F.lit("order").alias("node_type"), F.lit("").alias("label")))


@query(f"WITH {ED}, b AS (SELECT s AS node_id, t AS nb, 'outgoing' AS direction, l FROM ed UNION ALL SELECT t, s, 'incoming', l FROM ed) SELECT node_id, direction, l AS relation_label, CASE WHEN coalesce(name, '') = '' THEN nb ELSE k || ': ' || name END AS neighbour, count(*) AS n FROM b LEFT JOIN nd ON nb = id GROUP BY ALL")
def ego_neighbors(spark, sf):
    edges, nodes = order_graph(spark, sf)
    return graph.neighbours(edges, nodes).groupBy("node_id", "direction", "relation_label", "neighbour").agg(F.count("*").alias("n"))


@query(f"WITH {ED} SELECT l AS relation_label, coalesce(x.name, '') AS source_label, coalesce(y.name, '') AS target_label, count(*) AS n FROM ed LEFT JOIN nd x ON s = x.id LEFT JOIN nd y ON t = y.id WHERE l IN ('USES_TOOL', 'RECEIVES', 'CONTEXT_FOR') OR l = 'FROM_SUPPLIER' GROUP BY ALL")
def subgraph_detail(spark, sf):
    edges, nodes = order_graph(spark, sf)
    typed = edges.withColumn("relation_type", F.when(F.col("relation_label") == "FROM_SUPPLIER", "CAUSAL").otherwise("OTHER"))
    return graph.labelled(graph.strong(typed), nodes).groupBy("relation_label", "source_label", "target_label").agg(F.count("*").alias("n"))


def hierarchy(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as supers, their customers as macros, timed by their balance, and a row for each member."""
    c = read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("macro_id"), F.col("c_name").alias("label"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("super_id"), F.col("c_acctbal").alias("t_start"), (F.col("c_acctbal") + 10).alias("t_end"))
    supers = read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("super_id"), F.col("n_name").alias("label"))
    return supers, c.drop("super_id"), c.select("super_id", F.col("macro_id").alias("pos"), "macro_id")


@query("SELECT 'n' || n_nationkey AS super_id, n_name AS label, count(*) AS num_macros, string_agg('c' || c_custkey, ',' ORDER BY 'c' || c_custkey) AS macros FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 5000 GROUP BY ALL")
def super_rollup(spark, sf):
    supers, macros, listed = hierarchy(spark, sf)
    return graph.super_events(supers, macros, cutoff=5000, listed=listed).select("super_id", "label", "num_macros", F.array_join("macro_ids", ",").alias("macros"))


@query("SELECT 'n' || c_nationkey AS super_id, round(min(c_acctbal), 2) AS t_start, round(max(c_acctbal + 10), 2) AS t_end FROM customer GROUP BY ALL")
def super_time_range(spark, sf):
    _, macros, listed = hierarchy(spark, sf)
    return graph.super_ranges(listed, macros).withColumns({c: F.round(c, 2) for c in ("t_start", "t_end")})


@query("SELECT 'c' || c_custkey AS macro_id, c_name AS label, c_acctbal AS t_start FROM customer WHERE c_nationkey = 3 AND c_acctbal < 8000")
def macro_drilldown(spark, sf):
    supers, macros, listed = hierarchy(spark, sf)
    return graph.macro_events(macros, supers, super_id="n3", cutoff=8000, listed=listed).select("macro_id", "label", "t_start")


@query("SELECT 'c' || c_custkey AS macro_id, 'n' || c_nationkey AS super_id FROM customer")
def super_backlink(spark, sf):
    return graph.super_of_macro(hierarchy(spark, sf)[2])


#: Sentences end after these; the fold joins one to the last chunk while both have 500 characters at most.
ENDS, BLANK = ".!?。！？\\n", "[ \\t\\n\\x0B\\f\\r]+"
CHUNKS = (
    f"se AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^{ENDS}]*[{ENDS}]|[^{ENDS}]+'), lambda x: regexp_replace(x, '^{BLANK}|{BLANK}$', '', 'g')), lambda x: x <> '') AS s FROM documents), "
    "fo AS (SELECT doc_id, list_reduce([['']] || list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN a[-1] = '' THEN x WHEN length(a[-1]) + length(x[1]) <= 500 THEN a[:-2] || [a[-1] || ' ' || x[1]] ELSE a || x END) AS c FROM se), "
    "ch AS (SELECT doc_id, i, c[i + 1] AS text FROM (SELECT doc_id, c, unnest(range(0, len(c))) AS i FROM fo)), "
    "asr AS (SELECT 'asr_' || doc_id || '_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS node_id, 'asr_text' AS node_type, text, CAST(doc_id AS VARCHAR) AS macro_id FROM ch WHERE length(text) >= 3)"
)


def transcripts(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("macro_id"), F.col("text").alias("asr_text"))


@query(f"WITH {CHUNKS} SELECT * FROM asr")
def asr_chunking(spark, sf):
    return merge.transcript_nodes(transcripts(spark, sf))


@query(
    f"WITH {CHUNKS} SELECT 'c' || c_custkey AS node_id, 'entity' AS node_type, concat_ws(' ', nullif(c_name, ''), nullif(c_mktsegment, '')) AS text, 'n' || c_nationkey AS macro_id FROM customer "
    "UNION ALL SELECT 'e' || event_id, 'event', concat_ws(' ', 'u' || user_id, nullif(event_type, ''), nullif(props, '')), 'u' || user_id FROM events "
    "UNION ALL SELECT 'p' || page_id, 'on_screen_text', coalesce(url, ''), 'pages' FROM pages UNION ALL SELECT * FROM asr"
)
def node_union(spark, sf):
    """Search nodes of four kinds, over whole tables."""
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    entities = read(spark, sf, "customer").select(named("c", "c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), named("n", "c_nationkey").alias("macro_id"))
    events = read(spark, sf, "events").select(named("e", "event_id").alias("event_id"), named("u", "user_id").alias("subject"), F.col("event_type").alias("action"), F.lit("").alias("object"), F.col("props").alias("description"), named("u", "user_id").alias("macro_id"))
    screens = read(spark, sf, "pages").select(named("p", "page_id").alias("text_id"), F.col("url").alias("text"), F.lit("").alias("description"), F.lit("pages").alias("macro_id"))
    return merge.all_nodes(entities, events, screens, transcripts(spark, sf))


@query(
    "WITH h AS (SELECT o_orderkey AS node_id, o_totalprice AS score FROM orders ORDER BY score DESC, node_id LIMIT 50) SELECT node_id, score, o_orderstatus AS node_type, 'c' || o_custkey AS macro_id, c_name AS macro_label, CAST(c_acctbal AS DOUBLE) AS t_start, 'n' || c_nationkey AS super_id, n_name AS super_label "
    "FROM h JOIN orders ON node_id = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
)
def hit_details(spark, sf):
    """The 50 best hits with their node, macro and super."""
    supers, macros, listed = hierarchy(spark, sf)
    orders = read(spark, sf, "orders")
    hits = index.top(orders.select(F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").alias("score")), 50)
    nodes = orders.select(F.col("o_orderkey").alias("node_id"), F.col("o_orderstatus").alias("node_type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("macro_id"))
    return graph.hit_details(hits, nodes, macros, supers, listed=listed).select("node_id", "score", "node_type", "macro_id", "macro_label", F.col("t_start").cast("double").alias("t_start"), "super_id", "super_label")


@query("WITH m AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT o_orderkey, o_custkey AS source, o_orderkey % 97 + 1 AS target FROM orders WHERE o_custkey IN (SELECT k FROM m) AND o_orderkey % 97 + 1 IN (SELECT k FROM m)")
def kept_relations(spark, sf):
    """Relations with both ends among the macros that are kept."""
    macros = read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("macro_id"))
    relations = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 97 + 1).alias("target"))
    return graph.kept_relations(relations, macros).select("o_orderkey", "source", "target")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, role, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations) WHERE coalesce(role, '') <> 'assistant' OR n <= 2")
def capped_images(spark, sf):
    """The first two images of a stream; the limit is the operator's feature."""
    return trace.capped_images(read(spark, sf, "conversations"), "conv_id", "turn", F.coalesce(F.col("role") == "assistant", F.lit(False)), 2).select("conv_id", "turn")


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN lag(CASE WHEN length(text) < 200 THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) END AS caption FROM conversations")
def carried_label(spark, sf):
    label = F.when(F.length("text") < 200, F.col("text"))
    return trace.carried_label(read(spark, sf, "conversations"), "conv_id", "turn", label, F.col("role") == "assistant").select("conv_id", "turn", "caption")


def cuts_of(spark, sf) -> DataFrame:
    ev = read(spark, sf, "events").withColumn("s", seconds())
    hourly = ev.groupBy((F.col("user_id") % 10).alias("video"), (F.floor(F.col("s") / 3600) * 3600.0).alias("t")).agg(F.round(F.max("value"), 2).alias("v"))
    return segment.cut_scores(hourly, "video", "t", ["v"]).withColumn("score", F.round("score", 2))


CUT = EV + ", hr AS (SELECT user_id % 10 AS video, floor(s / 3600) * 3600.0 AS t, round(max(value), 2) AS v FROM ev GROUP BY ALL), cu AS (SELECT * FROM (SELECT video, t, round(abs(v - lag(v) OVER (PARTITION BY video ORDER BY t)), 2) AS score FROM hr) WHERE score IS NOT NULL)"


@query(f"WITH {CUT} SELECT * FROM cu")
def cut_scores(spark, sf):
    return cuts_of(spark, sf)


@query(
    f"WITH RECURSIVE {CUT}, b AS (SELECT video, t FROM cu WHERE score >= 20), k AS (SELECT video, min(t) AS t FROM b WHERE t >= 7200 GROUP BY video UNION ALL SELECT k.video, (SELECT min(b.t) FROM b WHERE b.video = k.video AND b.t - k.t >= 7200) AS t FROM k WHERE k.t IS NOT NULL) SELECT video, t FROM k WHERE t IS NOT NULL"
)
def greedy_gap(spark, sf):
    b = cuts_of(spark, sf).where("score >= 20").groupBy("video").agg(F.array_sort(F.collect_list("t")).alias("b"))
    return b.select("video", F.explode(segment.greedy(F.col("b"), F.lit(0.0), 7200)).alias("t"))


def kept_sql(scores: str) -> str:
    """Greedy choice of ascending times by a fold over one-element lists, after a first 0."""
    return f"list_reduce([[CAST(0 AS DOUBLE)]] || list_transform({scores}, lambda x: [CAST(x.t AS DOUBLE)]), lambda a, x: CASE WHEN x[1] - a[-1] >= 7200 THEN a || x ELSE a END)"


LISTS = CUT + ", li AS (SELECT video, list({'t': t, 'score': score} ORDER BY t) AS c, list_sort(list_distinct(list(score))) AS lv FROM cu GROUP BY video)"


@query(
    f"WITH {LISTS}, e AS (SELECT video, {kept_sql('list_filter(c, lambda y: y.score >= 20)')} AS e FROM li), r AS (SELECT video, i, len(e) AS n, e[i] AS a, coalesce(e[i + 1], CAST(2592000 AS DOUBLE)) AS b FROM (SELECT video, e, unnest(range(1, len(e) + 1)) AS i FROM e)), "
    "s AS (SELECT *, i = n AND n > 1 AND b - a < 7200 AS short FROM r), k AS (SELECT *, CASE WHEN b - a > 14400 THEN greatest(2, CAST(round_even((b - a) / (14400 * 0.7), 0) AS BIGINT)) ELSE 1 END AS parts, coalesce(lead(short) OVER (PARTITION BY video ORDER BY i), false) AS takes FROM s), "
    "p AS (SELECT *, unnest(range(0, parts)) AS j FROM k WHERE NOT short) SELECT video, CAST(row_number() OVER (PARTITION BY video ORDER BY i, j) - 1 AS INTEGER) AS pos, a + j * (b - a) / parts AS t_start, "
    "CASE WHEN j < parts - 1 THEN a + (j + 1) * (b - a) / parts WHEN takes THEN CAST(2592000 AS DOUBLE) ELSE b END AS t_end FROM p"
)
def segment_split(spark, sf):
    return segment.segmented(cuts_of(spark, sf), "video", 0.0, 2_592_000.0, 20.0, 7200.0, 14_400.0)


@query(
    f"WITH RECURSIVE {LISTS}, bi AS (SELECT video, c, lv, CAST(0 AS BIGINT) AS lo, len(lv) - 1 AS hi, CAST('inf' AS DOUBLE) AS near, lv[1] AS best FROM li UNION ALL "
    "SELECT video, c, lv, CASE WHEN off < 0 THEN mid + 1 ELSE lo END, CASE WHEN off < 0 THEN hi ELSE mid - 1 END, least(near, abs(off)), CASE WHEN abs(off) < near THEN lv[mid + 1] ELSE best END FROM ("
    "SELECT *, list_sort(list_transform(range(1, len(e) + 1), lambda i: coalesce(e[i + 1], CAST(2592000 AS DOUBLE)) - e[i]))[len(e) // 2 + 1] - 46800 AS off FROM ("
    f"SELECT *, {kept_sql('list_filter(c, lambda y: y.score >= lv[mid + 1])')} AS e FROM (SELECT *, (lo + hi) // 2 AS mid FROM bi WHERE lo <= hi)))) SELECT video, best AS threshold FROM bi WHERE lo > hi"
)
def threshold_autoselect(spark, sf):
    return segment.thresholds(cuts_of(spark, sf), "video", 0.0, 2_592_000.0, 7200.0, 86_400.0)


@query(
    f"WITH {UD}, d AS (SELECT user_id % 20 AS g, t_end - t_start AS d FROM ud) SELECT g, count(*) AS n, min(d) AS min_sec, max(d) AS max_sec, round(avg(d), 4) AS avg_sec, count(*) FILTER (d < 60) AS n_short, count(*) FILTER (d > 600) AS n_long, list_sort(list(d))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median_sec FROM d GROUP BY g"
)
def scene_stats(spark, sf):
    rows = user_days(spark, sf).withColumn("g", F.col("user_id") % 20)
    return segment.scene_stats(rows, "g").withColumn("avg_sec", F.round("avg_sec", 4))


@query(
    "WITH m AS (SELECT 'c' || c_custkey AS macro_id, c_name AS label, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey * 10.0 AS t_start, c_custkey * 10.0 + 10.0 AS t_end FROM customer), g AS (SELECT *, CAST(floor(pos / (SELECT greatest(1, count(*) // 10) FROM customer)) AS BIGINT) AS g FROM m) "
    "SELECT 'super_' || CASE WHEN g < 10 THEN '0' ELSE '' END || g AS super_id, 'Phase ' || (g + 1) AS label, CAST(count(*) AS INTEGER) AS num_macros, string_agg(label, '; ' ORDER BY pos) AS description, arg_min(t_start, pos) AS t_start, arg_max(t_end, pos) AS t_end FROM g GROUP BY g"
)
def fallback_supers(spark, sf):
    m = read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("macro_id"), F.col("c_name").alias("label"), (F.col("c_custkey") * 10.0).alias("t_start"), (F.col("c_custkey") * 10.0 + 10.0).alias("t_end"))
    return segment.fallback_supers(m, F.col("t_start")).drop("sub_macro_ids")


@query("SELECT source || '_' || doc_id AS node_id, CASE WHEN coalesce(lang, '') = '' THEN lang ELSE source || '_' || lang END AS super_id FROM documents WHERE source IS NOT NULL")
def merge_prefix(spark, sf):
    d = read(spark, sf, "documents").where("source is not null").select("source", F.col("doc_id").cast("string").alias("node_id"), F.col("lang").alias("super_id"))
    return merge.prefixed(d, F.col("source"), ["node_id", "super_id"]).select("node_id", "super_id")


@query(
    "WITH s AS (SELECT source, min(doc_id) AS pos, list(DISTINCT lang) AS themes FROM documents WHERE source IS NOT NULL GROUP BY source), t AS (SELECT list_sort(list(DISTINCT x))[1:50] AS themes FROM (SELECT unnest(themes) AS x FROM s) WHERE x IS NOT NULL), e AS (SELECT list_sort(list(DISTINCT source))[1:100] AS k FROM s), n AS (SELECT count(*) AS n FROM s), o AS (SELECT string_agg(source, '; ' ORDER BY pos) AS d FROM (SELECT * FROM s ORDER BY pos LIMIT 20)) "
    "SELECT array_to_string(t.themes, ',') AS themes, array_to_string(e.k, ',') AS key_entities, CASE WHEN n > 20 THEN d || '... and ' || (n - 20) || ' more' ELSE d END AS description FROM t, e, n, o"
)
def merge_root_rollup(spark, sf):
    d = read(spark, sf, "documents").where("source is not null").groupBy("source").agg(F.min("doc_id").alias("pos"), F.collect_set("lang").alias("themes"))
    roots = d.select("pos", F.col("source").alias("title"), "themes", F.array("source").alias("key_entities"))
    return merge.root_rollup(roots).select(F.array_join("themes", ",").alias("themes"), F.array_join("key_entities", ",").alias("key_entities"), "description")


@query(f"WITH {UD} SELECT macro_id, 'macro_' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, len(CAST(n AS VARCHAR))) AS INTEGER), '0') AS new_id FROM (SELECT macro_id, row_number() OVER (ORDER BY t_start, day, user_id) - 1 AS n FROM ud)")
def chunk_renumber(spark, sf):
    return merge.renumbered(user_days(spark, sf), "day", "t_start", "user_id").select("macro_id", "new_id")


@query("WITH a AS (SELECT source, count(*) AS n_macros FROM documents WHERE source IS NOT NULL GROUP BY source), b AS (SELECT source, count(*) AS n_supers FROM (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL) GROUP BY source) SELECT source, n_macros, n_supers FROM a JOIN b USING (source)")
def source_counts(spark, sf):
    d = read(spark, sf, "documents").where("source is not null")
    return merge.source_counts(d, d.select("source", "lang").distinct(), "source")


CLOCK_SQL = "lpad(CAST(x // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x % 60 AS VARCHAR), 2, '0')"


@query(f"WITH {EV}, d AS (SELECT event_id, s, CAST(s AS BIGINT) // 100000 AS day, CAST(s AS BIGINT) % 100000 AS x FROM ev) SELECT event_id, 'DAY' || (day + 1) || ' ' || {CLOCK_SQL} AS shown, s AS back FROM d")
def time_format_parse(spark, sf):
    ev = read(spark, sf, "events").select("event_id", seconds().alias("s"))
    return ev.select("event_id", timeexpr.day_hms(F.col("s")).alias("shown"), timeexpr.parse_item(timeexpr.day_hms(F.col("s"))).alias("back"))


@query(
    "WITH d AS (SELECT event_id, event_id % 9 AS day FROM events) SELECT event_id, (day - 1) * 100000 + CASE day "
    + " ".join(f"WHEN {d} THEN {s}" for d, s in timeexpr.RECORDING_START.items())
    + " ELSE 0 END AS base FROM d"
)
def day_offset_rebase(spark, sf):
    return read(spark, sf, "events").select("event_id", timeexpr.day_base(F.col("event_id") % 9).alias("base"))


@query("SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS turn_no FROM conversations")
def turn_assembly(spark, sf):
    return trace.turns(read(spark, sf, "conversations"), "conv_id", "turn", F.coalesce(F.col("role") == "user", F.lit(False))).select("conv_id", "turn", "turn_no")


@query("SELECT c_custkey, arg_max(event_type, event_id) AS result FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY c_custkey")
def tool_result_join(spark, sf):
    results = read(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("line_no"), F.col("event_type").alias("result"))
    return trace.with_results(read(spark, sf, "customer").select("c_custkey"), results, call="c_custkey")


@query("SELECT conv_id || '-' || turn AS id, CASE WHEN max(CASE WHEN role = 'user' THEN turn END) OVER w IS NULL THEN NULL ELSE conv_id || '-' || max(CASE WHEN role = 'user' THEN turn END) OVER w END AS ancestor FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def user_ancestor(spark, sf):
    c = read(spark, sf, "conversations")
    nodes = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1)).alias("parent"), F.coalesce(F.col("role") == "user", F.lit(False)).alias("is_user"))
    return trace.user_ancestors(nodes)


SRT = "lpad(CAST(x // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST(x % 1000 AS VARCHAR), 3, '0')"


@query(f"WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, turn * 7250 AS a_, turn * 7250 + 5125 AS b_ FROM conversations) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY a_) AS INTEGER) AS cue_no, row_number() OVER (PARTITION BY conv_id ORDER BY a_) || chr(10) || {SRT.replace('x', 'a_')} || ' --> ' || {SRT.replace('x', 'b_')} || chr(10) || role AS cue FROM c")
def srt_export(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", F.coalesce("role", F.lit("")).alias("role"), (F.col("turn") * 7.25).alias("a"), (F.col("turn") * 7.25 + 5.125).alias("b"))
    return preview.srt(c, "conv_id", "a", "b", "role")


@query("SELECT conv_id, array_to_string(list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)), ',') AS speakers FROM conversations GROUP BY conv_id")
def speaker_set(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("speakers"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit("<think>a {b}</think>Here:\n```json\n"), "props", F.lit("\n```")).alias("answer"))
    return e.select("event_id", F.get_json_object(text.model_json(F.col("answer")), "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, 'e' || event_id AS label, CAST(round_even((event_id % 1000) / 1000.0 * 96, 0) AS INTEGER) AS x1, CAST(round_even((event_id % 700) / 1000.0 * 64, 0) AS INTEGER) AS y2 FROM events")
def grounding_parse(spark, sf):
    e = read(spark, sf, "events").withColumn("a", (F.col("event_id") % 1000).cast("string")).withColumn("b", (F.col("event_id") % 700).cast("string"))
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('[{"label": "e'), F.col("event_id").cast("string"), F.lit('", "bbox_2d": ['), "a", F.lit(", 0, 1000, "), "b", F.lit("],}]"))).otherwise(F.concat(F.lit("<ref>e"), F.col("event_id").cast("string"), F.lit("</ref><box>("), "a", F.lit(",0),(1000,"), "b", F.lit(")</box>")))
    boxes = e.select("event_id", F.explode(text.grounding(answer, F.lit(96), F.lit(64))).alias("g"))
    return boxes.select("event_id", "g.label", F.col("g.bbox")[0].alias("x1"), F.col("g.bbox")[3].alias("y2"))


@query("SELECT coalesce(nullif(url, ''), 'N/A') AS link, 'N/A' AS date, CAST(page_id AS VARCHAR) AS title, left(html, 50) AS snippet FROM pages")
def provider_normalize(spark, sf):
    p = read(spark, sf, "pages").withColumn("cut", F.substring("html", 1, 50))
    return graph.provider_results(p, "url", "page_id", "cut", None)


@query("SELECT page_id, left(html, 8000) AS head, len(html) > 8000 AS cut FROM pages")
def page_truncate(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.substring("html", 1, 8000).alias("head"), (F.length("html") > 8000).alias("cut"))


RULES = {"script_tag": "<script", "inline_style": "style=", "image": "<img", "heading": "<h[1-6]"}


@query("WITH r(rule, p) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in RULES.items()) + "), c AS (SELECT rule, len(regexp_extract_all(html, p)) AS n FROM pages, r WHERE html IS NOT NULL) SELECT rule, count(*) FILTER (n > 0) AS n_files, CAST(sum(n) AS BIGINT) AS n, sum(n) = 0 AS passed FROM c GROUP BY rule")
def html_checks(spark, sf):
    return preview.verdicts(preview.violations(read(spark, sf, "pages"), RULES, "page_id", "html"), list(RULES))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def table_preview(spark, sf):
    return preview.head(read(spark, sf, "part").select("p_partkey", "p_name").orderBy("p_partkey"))[0]


@query("SELECT p_partkey, array_to_string(CASE WHEN p_size >= 5 THEN [0, 2] || range(4, least(8, p_size)) WHEN p_size >= 3 THEN [0, 2] ELSE [0] END, ',') AS pages FROM part")
def page_ranges(spark, sf):
    p = read(spark, sf, "part")
    return p.select("p_partkey", F.array_join(text.page_indices(F.lit("1,3,5-8,3"), F.col("p_size")).cast("array<string>"), ",").alias("pages"))


@query("WITH d AS (SELECT DISTINCT l_suppkey, l_linenumber AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS g FROM d), r AS (SELECT l_suppkey, min(n) AS a, max(n) AS b FROM g GROUP BY l_suppkey, g) SELECT l_suppkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY l_suppkey")
def compact_ranges(spark, sf):
    return preview.compact(read(spark, sf, "lineitem"), "l_suppkey", "l_linenumber")


@query("SELECT p_partkey, array_to_string(l, ',') AS at FROM (SELECT p_partkey, CASE WHEN p_size > 5 THEN list_transform(range(0, 5), lambda i: CAST(round_even(i * (p_size - 1) / 4.0, 0) AS INTEGER)) ELSE list_transform(range(0, p_size), lambda i: CAST(i AS INTEGER)) END AS l FROM part)")
def even_sample(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(preview.even_positions(F.col("p_size"), 5).cast("array<string>"), ",").alias("at"))


BEAT = "be AS (SELECT user_id % 10 AS k, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS i, 0.5 * (row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1) + (event_id % 7) / 1000.0 AS t FROM events)"


@query(f"WITH {BEAT}, f AS (SELECT k, regr_slope(t, i) AS p, regr_intercept(t, i) AS t0 FROM be GROUP BY k) SELECT k, round(any_value(t0), 6) AS t0, round(any_value(p), 6) AS period, round(60 / any_value(p), 6) AS bpm, round(max(abs(t - t0 - i * p)) * 1000, 4) AS worst_ms, max(abs(t - t0 - i * p)) * 1000 <= 15 AS trusted FROM be JOIN f USING (k) GROUP BY k")
def beat_fit(spark, sf):
    i = F.col("n") - 1
    ev = running_count(read(spark, sf, "events").withColumn("k", F.col("user_id") % 10), ["k"], "event_id", F.lit(True), "n")
    got = signal.beat_fit(ev.select("k", i.alias("i"), (0.5 * i + (F.col("event_id") % 7) / 1000.0).alias("t")), "k")
    return got.select("k", F.round("t0", 6).alias("t0"), F.round("period", 6).alias("period"), F.round("bpm", 6).alias("bpm"), F.round("worst_ms", 4).alias("worst_ms"), "trusted")


@query("WITH n AS (SELECT user_id % 10 AS k, event_id, value < 40 AS low, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS i FROM events), r AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY event_id) AS g FROM n WHERE low) SELECT k, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY k, g HAVING count(*) >= 3")
def silence_gaps(spark, sf):
    return signal.silences(read(spark, sf, "events").withColumn("k", F.col("user_id") % 10), "k", "event_id", "value", 40.0, 3)


@query("WITH w AS (SELECT user_id % 10 AS k, event_id // 100 AS win, sqrt(sum(value * value) / 100) AS r FROM events GROUP BY ALL) SELECT k, win, round(r / max(r) OVER (PARTITION BY k), 6) AS rms FROM w")
def rms_envelope(spark, sf):
    ev = read(spark, sf, "events").select((F.col("user_id") % 10).alias("k"), F.col("event_id").alias("i"), F.col("value").alias("x"))
    return signal.envelope(ev, "k", 100).withColumn("rms", F.round("rms", 6))


@query("SELECT user_id, round(avg(value) / 255, 6) AS y_mean, round((avg(value + 100) - avg(value / 2)) / 255, 6) AS y_range, round(avg(value / 4) / 255, 6) AS sat_mean FROM events GROUP BY user_id")
def signal_stats(spark, sf):
    ev = read(spark, sf, "events").select("user_id", F.col("value").alias("y_avg"), (F.col("value") / 2).alias("y_min"), (F.col("value") + 100).alias("y_max"), (F.col("value") / 4).alias("sat_avg"))
    return signal.picture_stats(ev, "user_id").withColumns({c: F.round(c, 6) for c in ("y_mean", "y_range", "sat_mean")})


@query(
    "WITH x AS (SELECT event_id, (event_id % 100) / 100.0 AS y, (event_id % 83) / 83.0 AS r, (event_id % 61) / 61.0 AS s FROM events), v AS (SELECT event_id, CASE WHEN r < 0.65 THEN 1.08 - 0.05 * greatest(0.0, least(1.0, (r - 0.5) / 0.15)) ELSE 1.03 END AS c, CASE WHEN y < 0.42 THEN 1.1 - 0.08 * greatest(0.0, least(1.0, (y - 0.3) / 0.12)) WHEN y > 0.6 THEN 0.97 ELSE 1.0 END AS g, CASE WHEN s < 0.18 THEN 1.04 WHEN s > 0.38 THEN 0.96 ELSE 0.98 END AS k FROM x) "
    "SELECT event_id, round(c, 4) > 1.03 AS lifted, g <> 1.0 AS has_gamma, k AS saturation FROM v"
)
def grade_decision(spark, sf):
    e = read(spark, sf, "events").select("event_id", media.grade(F.col("event_id") % 100 / 100.0, F.col("event_id") % 83 / 83.0, F.col("event_id") % 61 / 61.0).alias("g"))
    return e.select("event_id", (F.regexp_extract("g", "contrast=([0-9.]+)", 1).cast("double") > 1.03).alias("lifted"), F.contains("g", F.lit("gamma=")).alias("has_gamma"), F.regexp_extract("g", "saturation=([0-9.]+)", 1).cast("double").alias("saturation"))


@query("SELECT event_id, CAST(greatest(0, event_id % 300 - 50) AS INTEGER) AS x1, 200 AS x2 FROM events WHERE greatest(0, event_id % 300 - 50) < 200")
def crop_clamp(spark, sf):
    c = F.col("event_id").cast("int")
    box = read(spark, sf, "events").select("event_id", media.crop(c % 300 - 50, F.lit(0), F.lit(400), F.lit(90), F.lit(200), F.lit(100)).alias("b"))
    return box.where("b is not null").select("event_id", "b.x1", "b.x2")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY event_type")
def incremental_missing(spark, sf):
    from mnemograph.streaming.incremental import missing

    ev = read(spark, sf, "events")
    return missing(ev, ev.where("event_id % 3 = 0"), "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT page_id, url, row_number() OVER (ORDER BY page_id) + 4 AS no FROM pages WHERE coalesce(url, '') <> ''")
def numbered_results(spark, sf):
    return preview.numbered_results(read(spark, sf, "pages").select("page_id", "url"), "page_id", "url", first=5)


@query("SELECT user_id, event_id, round(coalesce(sum(value + 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS start FROM events")
def clip_clock(spark, sf):
    clips = read(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("duration"))
    return signal.clip_clock(clips, "user_id", "event_id", 0.5).select("user_id", "event_id", "start")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def global_ranks(spark, sf):
    return global_rank(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_orderkey", "rank")


POINTS = ("CAST(l_orderkey % 97 AS DOUBLE)", "CAST(l_partkey % 89 AS DOUBLE)", "CAST(l_suppkey % 83 AS DOUBLE)", "CAST(l_linenumber * 11 % 79 AS DOUBLE)")


def _geometry_sql() -> str:
    """Points a = (p, q), b = (r, s), c = (q, p), d = (s, r); vectors ab = (r - p, s - q), cd = (s - q, r - p)."""
    size = "sqrt((r - p) * (r - p) + (s - q) * (s - q))"
    turn = "((r - p) * (r - p) - (s - q) * (s - q))"
    t = f"(((q - p) * (r - p) - (p - q) * (s - q)) / {turn})"
    ac, bc = "sqrt((q - p) * (q - p) + (p - q) * (p - q))", "sqrt((q - r) * (q - r) + (p - s) * (p - s))"
    return (
        f"WITH g AS (SELECT l_returnflag, {POINTS[0]} AS p, {POINTS[1]} AS q, {POINTS[2]} AS r, {POINTS[3]} AS s FROM lineitem), l AS (SELECT *, {size} AS z, {ac} AS ac, {bc} AS bc FROM g) "
        "SELECT l_returnflag, count(*) FILTER (z >= 1e-9 AND abs((r - p) * (r - p) - (s - q) * (s - q)) / (z * z) * z < 1) AS parallel, "
        "count(*) FILTER (z >= 1e-9 AND abs((r - p) * (s - q) + (s - q) * (r - p)) / (z * z) * z < 1) AS perpendicular, "
        "count(*) FILTER (sqrt(((p + r) / 2 - q) * ((p + r) / 2 - q) + ((q + s) / 2 - p) * ((q + s) / 2 - p)) < 1) AS midpoint, "
        "count(*) FILTER (z >= 1e-9 AND abs((r - p) * (p - q) - (s - q) * (q - p)) / z < 1) AS on_line, "
        "count(*) FILTER (z >= 1e-9 AND abs((r - p) * (p - q) - (s - q) * (q - p)) / z < 1 AND ((q - p) * (r - p) + (p - q) * (s - q)) / (z * z) BETWEEN -(1 / z) AND 1 + 1 / z) AS on_segment, "
        "count(*) FILTER (CASE WHEN greatest(z, ac, bc) < 1e-9 THEN true ELSE abs((r - p) * (p - q) - (s - q) * (q - p)) / greatest(z, ac, bc) < 1 END) AS collinear, "
        f"count(*) FILTER (CASE WHEN abs({turn}) < 1e-9 THEN false ELSE sqrt((p + {t} * (r - p) - r) * (p + {t} * (r - p) - r) + (q + {t} * (s - q) - r) * (q + {t} * (s - q) - r)) < 1 END) AS meeting, "
        "count(*) FILTER (z >= 1e-9 AND abs(z / z - 1) < 0.02) AS same_length FROM l GROUP BY l_returnflag"
    )


@query(_geometry_sql())
def geometry_checks(spark, sf):
    """Predicates on the points a = (p, q), b = (r, s) and their mirror images c and d."""
    g = read(spark, sf, "lineitem").select("l_returnflag", *(F.expr(x).alias(n) for n, x in zip("pqrs", POINTS, strict=True)))
    a, b, c, d = (geometry.point(F.col(x), F.col(y)) for x, y in ("pq", "rs", "qp", "sr"))
    found = {
        "parallel": geometry.parallel(a, b, c, d), "perpendicular": geometry.perpendicular(a, b, c, d), "midpoint": geometry.midpoint(c, a, b), "on_line": geometry.on_line(c, a, b),
        "on_segment": geometry.on_segment(c, a, b), "meeting": geometry.intersection(geometry.point(F.col("r"), F.col("r")), a, b, c, d), "collinear": geometry.collinear(a, b, c), "same_length": geometry.ratio(a, b, c, d, F.lit(1.0)),
    }
    return g.groupBy("l_returnflag").agg(*(F.count_if(x).alias(n) for n, x in found.items()))


RECTS = {"x0": "c_custkey * 37 % 500", "y0": "c_custkey * 53 % 300", "w": "20 + c_custkey % 31", "h": "8 + c_custkey % 7"}


@query(
    "WITH r AS (SELECT c_custkey // 200 AS page, c_custkey AS id, CAST(c_custkey * 37 % 500 AS DOUBLE) AS x0, CAST(c_custkey * 53 % 300 AS DOUBLE) AS y0, CAST(20 + c_custkey % 31 AS DOUBLE) AS w, CAST(8 + c_custkey % 7 AS DOUBLE) AS h FROM customer) "
    "SELECT a.page, a.id AS a, b.id AS b FROM r a JOIN r b ON a.page = b.page AND a.id < b.id WHERE least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0) > 0.35 * least(a.w, b.w) AND least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0) > 0.35 * least(a.h, b.h)"
)
def label_overlap(spark, sf):
    r = read(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 200).alias("page"), F.col("c_custkey").alias("rect_id"), *(F.expr(RECTS[n]).cast("double").alias(n) for n in ("x0", "y0", "w", "h")))
    return layout.overlapping(r.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h")), "page")


@query(
    "WITH o AS (SELECT DISTINCT o_orderpriority AS plan, o_custkey AS k FROM orders), e AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), p AS (SELECT o_orderpriority AS plan, count(*) AS planned FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) "
    "SELECT plan, coalesce(planned, 0) AS planned, count(k) AS built, count(*) FILTER (k IS NOT NULL AND k NOT IN (SELECT k FROM e)) AS missing, count(*) FILTER (k IS NOT NULL AND k NOT IN (SELECT k FROM e)) = 0 AND count(k) > 0 AND count(k) >= coalesce(planned, 0) AS ok FROM p FULL JOIN o USING (plan) GROUP BY plan, planned"
)
def scene_coverage(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("plan"), F.col("o_custkey").alias("k"), "o_orderstatus")
    there = read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    existing = orders.select("plan", "k").join(there, "k", "left_semi")
    return layout.coverage(orders, existing, orders.where("o_orderstatus = 'F'"), "plan", "k")


@query("SELECT l_orderkey, l_linenumber, least(frames / l_quantity, 0.5 + l_linenumber) AS fps, frames FROM (SELECT *, greatest(4, least(60, CAST(trunc(l_quantity * 2) AS INTEGER))) AS frames FROM lineitem)")
def dynamic_fps(spark, sf):
    x = media.dynamic_rate(F.col("l_quantity").cast("double"), F.lit(0.5) + F.col("l_linenumber"), 4, 60, 2.0)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.fps", "x.frames")


@query(f"WITH {UD}, n AS (SELECT macro_id, t_start, t_end, greatest(4, least(250, CAST(trunc((t_end - t_start) * 0.001) AS INTEGER) + 1)) AS n FROM ud WHERE t_end > t_start) SELECT macro_id, i, round(t_start + (t_end - t_start) * i / (n - 1), 6) AS t FROM (SELECT *, unnest(range(0, n)) AS i FROM n)")
def uniform_times(spark, sf):
    times = media.even_times(F.col("t_start"), F.col("t_end"), 0.001)
    return user_days(spark, sf).select("macro_id", F.posexplode(times).alias("i", "t")).select("macro_id", "i", F.round("t", 6).alias("t"))


@query("SELECT event_id, value FROM (SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 16) ORDER BY event_id")
def top_beats(spark, sf):
    return signal.strongest(read(spark, sf, "events").select("event_id", "value"), 16, "value", "event_id")


@query("SELECT user_id, CAST(sum(length(to_base64(CAST(props AS BLOB)))) AS BIGINT) AS bytes FROM events GROUP BY user_id")
def response_bytes(spark, sf):
    parts = F.array(F.base64(F.col("props").cast("binary")))
    return read(spark, sf, "events").groupBy("user_id").agg(F.sum(media.payload_bytes(parts)).alias("bytes"))


@query("SELECT doc_id, replace(regexp_replace(text, '[（）()\"'']', '', 'g'), '：', '，') AS spoken FROM documents")
def tts_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.speakable(F.col("text")).alias("spoken"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(trunc(o_totalprice) AS BIGINT) ELSE o_orderkey % 4 END AS n FROM orders")
def counting_fallback(spark, sf):
    listed = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= F.col("o_orderkey") % 4, F.struct(i.alias("t"))))
    listed = F.filter(listed, lambda x: x.isNotNull())
    answer = F.to_json(F.struct(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("count"), listed.alias("occurrences")))
    return read(spark, sf, "orders").select("o_orderkey", text.stated_count(answer).alias("n"))


@query("SELECT c_custkey, c_mktsegment || ':slot' || c_nationkey || '_' || c_name AS key, c_name AS own FROM customer")
def node_ids(spark, sf):
    slot = F.concat(F.lit("slot"), F.col("c_nationkey"), F.lit("_"), F.col("c_name"))
    return read(spark, sf, "customer").select("c_custkey", text.node_key(F.col("c_mktsegment"), slot).alias("key"), text.own_id(slot).alias("own"))


@query(f"WITH {UD}, r AS (SELECT *, row_number() OVER (ORDER BY t_start, macro_id) - 1 AS pos FROM ud) SELECT printf('super_%02d', pos // 50) AS super_id, 'Window ' || (pos // 50 + 1) AS label, CAST(count(*) AS INTEGER) AS num_macros, arg_min(t_start, pos) AS t_start, arg_max(t_end, pos) AS t_end, string_agg(macro_id, ', ' ORDER BY pos) AS description FROM r GROUP BY pos // 50")
def window_supers(spark, sf):
    macros = user_days(spark, sf).select("macro_id", F.col("macro_id").alias("label"), "t_start", "t_end")
    return segment.window_supers(macros, F.col("t_start")).select("super_id", "label", "num_macros", "t_start", "t_end", "description")


@query(
    "WITH m AS (SELECT 'c' || c_custkey AS macro_id, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), g AS (SELECT *, CAST(floor(pos / (SELECT greatest(1, count(*) // 10) FROM customer)) AS BIGINT) AS g FROM m) "
    "SELECT 'super_' || CASE WHEN g < 10 THEN '0' ELSE '' END || g AS super_id, 'Phase ' || (g + 1) AS label, pos, macro_id FROM g"
)
def fallback_members(spark, sf):
    """The fallback's groups as a row a member."""
    c = read(spark, sf, "customer")
    m = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("macro_id"), F.col("c_custkey").alias("t_start"))
    return segment.grouped(m, F.col("t_start"), max(1, m.count() // 10), "Phase")


FORMS = "t AS (SELECT event_id, event_id % 7 AS f, event_id % 50 AS v, lpad(CAST(event_id % 50 AS VARCHAR), 2, '0') AS s FROM events)"


@query(
    f"WITH {FORMS} SELECT event_id, CAST(CASE f WHEN 0 THEN 103720 + v WHEN 1 THEN 214700 + v WHEN 2 THEN 3720 + v WHEN 3 THEN v + 0.5 ELSE 0 END AS DOUBLE) AS item, CAST(CASE f WHEN 0 THEN 103720 + v END AS DOUBLE) AS argument, CAST(CASE f WHEN 0 THEN 3720 + v WHEN 1 THEN 14700 + v WHEN 2 THEN 3720 + v WHEN 3 THEN v + 0.5 END AS DOUBLE) AS plain, "
    "CAST(CASE f WHEN 0 THEN 103720 + v WHEN 1 THEN 214700 + v WHEN 3 THEN v + 0.5 END AS DOUBLE) AS day_based, CAST(CASE f WHEN 2 THEN 3720 + v WHEN 3 THEN v + 0.5 WHEN 6 THEN 300 + v END AS DOUBLE) AS build, CAST(CASE f WHEN 2 THEN 3720 + v WHEN 3 THEN v + 0.5 WHEN 4 THEN v WHEN 6 THEN 300 + v END AS DOUBLE) AS shared FROM t"
)
def time_variants(spark, sf):
    """Seven ways to write a time under each of the parsers."""
    s, f = F.lpad((F.col("event_id") % 50).cast("string"), 2, "0"), F.col("event_id") % 7
    ways = [F.concat(F.lit("DAY2 01:02:"), s), F.concat(F.lit("day3_04:05:"), s), F.concat(F.lit("01:02:"), s), F.concat(s, F.lit(".5")), F.concat(s, F.lit("s")), F.lit("junk"), F.concat(F.lit("05:"), s)]
    t = read(spark, sf, "events").select("event_id", F.element_at(F.array(*ways), (f + 1).cast("int")).alias("t"))
    parsers = {"item": timeexpr.parse_item, "argument": timeexpr.parse_day_argument, "plain": timeexpr.parse_plain, "day_based": timeexpr.parse_day_based, "build": timeexpr.parse_build, "shared": timeexpr.parse_shared}
    return t.select("event_id", *(p(F.col("t")).alias(n) for n, p in parsers.items()))
