"""Postings, BM25, cosine and their reciprocal-rank fusion."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.functions.text import STOPWORDS, occurrences, token_count, tokens
from mnemograph.operators.rank import global_rank
from mnemograph.session import checkpointed, spread

K1, B, RRF = 1.2, 0.75, 60


def postings(nodes: DataFrame, id_col: str = "node_id", text_col: str = "text") -> DataFrame:
    """(node_id, term, tf, dl): a row for each term of a node; terms combine before the shuffle."""
    words = spread(nodes.select(F.col(id_col).alias("node_id"), F.col(text_col).alias("text"))).select("node_id", tokens(F.col("text")).alias("words")).withColumn("dl", F.size("words"))
    return words.select("node_id", "dl", F.explode("words").alias("term")).groupBy("node_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def of_types(nodes: DataFrame, node_types: list[str] | None, type_col: str = "node_type") -> Column:
    """Whether a node is of one of the types, in any case; without types all are."""
    return F.lit(True) if not node_types else F.lower(type_col).isin([t.lower() for t in node_types])


def query_terms(query: str) -> dict[str, int]:
    """The query's tokens with their multiplicity."""
    import re

    found = re.findall(r"[\w一-鿿]+", query.lower())
    return Counter(t for t in found if t not in STOPWORDS and len(t) > 1)


def bm25(nodes: DataFrame, query: str, id_col: str = "node_id", text_col: str = "text", node_types: list[str] | None = None, type_col: str = "node_type") -> DataFrame:
    """(node_id, bm25) of nodes with a query term; statistics are of all nodes, ``node_types`` only limits
    which ones are listed.

    One scan: each text is counted once for its length and once for the query's few terms; the counts,
    a few numbers a node, are checkpointed, and only a row of totals reaches the driver.
    """
    terms = query_terms(query)
    if not terms:
        return nodes.where("false").select(F.col(id_col).alias("node_id"), F.lit(0.0).alias("bm25"))
    texts = spread(nodes.select(F.col(id_col).alias("node_id"), of_types(nodes, node_types, type_col).alias("asked"), F.col(text_col).alias("text")))
    found = texts.select("node_id", "asked", token_count(F.col("text")).alias("dl"), occurrences(F.col("text"), [*terms]).alias("found"))
    times_in = lambda term: F.size(F.filter("found", lambda w: w == F.lit(term)))
    tf = [times_in(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = checkpointed(found.select("node_id", "asked", "dl", *tf))
    total = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    n, avgdl = total["n"], total["avgdl"] or 1.0
    score: Column = F.lit(0.0)
    for i, times in enumerate(terms.values()):
        idf = F.log((F.lit(float(n - total[f"df{i}"])) + 0.5) / (total[f"df{i}"] + 0.5) + 1)
        f = F.col(f"tf{i}")
        score = score + times * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / avgdl))
    some = F.lit(False)
    for i in range(len(terms)):
        some = some | (F.col(f"tf{i}") > 0)
    return counted.where(some & F.col("asked")).select("node_id", score.alias("bm25"))


def bm25_batch(nodes: DataFrame, queries: DataFrame, id_col: str = "node_id", text_col: str = "text") -> DataFrame:
    """(query_id, node_id, bm25) of many queries (query_id, query): one join on terms, no pair without one."""
    posts = postings(nodes, id_col, text_col)
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = checkpointed(posts.join(asked.select("term").distinct(), "term", "left_semi"))
    lengths = nodes.agg(F.count("*").alias("n"), F.avg(token_count(F.col(text_col))).alias("avgdl")).first()
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(lengths["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (lengths["avgdl"] or 1.0)))
    return wanted.join(df, "term").join(asked, "term").groupBy("query_id", "node_id").agg(F.sum(part).alias("bm25"))


def top_each(scored: DataFrame, k: int, by: str = "bm25") -> DataFrame:
    """The ``k`` best of each query_id, ties to the smaller node_id; a task keeps k rows a query."""
    order = Window.partitionBy("query_id").orderBy(F.col(by).desc(), "node_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector; 1 for a zero one."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(vectors: DataFrame, query: list[float], id_col: str = "node_id", vector_col: str = "embedding") -> DataFrame:
    """(node_id, cosine) with one vector given as a literal: a projection, no exchange."""
    q = F.array(*(F.lit(float(x)) for x in query))
    length = sum(float(x) ** 2 for x in query) ** 0.5 or 1.0
    v = F.col(vector_col)
    return vectors.where(v.isNotNull()).select(F.col(id_col).alias("node_id"), (dot(v, q) / (norm(v) * length)).alias("cosine"))


def fuse(dense: DataFrame | None, sparse: DataFrame) -> DataFrame:
    """(node_id, score, cosine): sum of 1 / (60 + rank) over both lists, ranks from 0."""
    right = global_rank(sparse.where("bm25 > 0"), F.col("bm25").desc(), F.col("node_id"), name="sparse_rank")
    share = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    if dense is None:
        return right.select("node_id", share("sparse_rank").alias("score"), F.lit(0.0).alias("cosine"))
    left = global_rank(dense, F.col("cosine").desc(), F.col("node_id"), name="dense_rank")
    both = left.join(right, "node_id", "full_outer")
    return both.select("node_id", (share("dense_rank") + share("sparse_rank")).alias("score"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def fused_top(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``fuse`` without ranking whole lists.

    A node below the first 60 + 2k places of both lists scores less than 2 / (120 + 2k), which k nodes of
    any list with k rows reach alone. So the winners are among those places; a node that is
    only in one list's places gets its rank in the other by counting what stands before it, for all
    candidates in one pass.
    """
    sparse, most = sparse.where("bm25 > 0"), RRF + 2 * k
    lists = []
    for scored, by in ((dense, "cosine"), (sparse, "bm25")):
        head = [(r["node_id"], r[by]) for r in top(scored.select("node_id", by), most, by).collect()]  # most rows
        lists.append((scored, by, head))
    wanted = sorted({node for _, _, head in lists for node, _ in head})
    ranks: list[dict] = []
    values: dict = {}
    for scored, by, head in lists:
        known = {node: at for at, (node, _) in enumerate(head)}
        others = [n for n in wanted if n not in known]
        own = [(r["node_id"], r[by]) for r in scored.where(F.col("node_id").isin(others)).select("node_id", by).collect()] if others and len(head) == most else []
        if own:
            before = [F.count_if((F.col(by) > v) | (F.col(by) == v) & (F.col("node_id") < n)).alias(f"r{i}") for i, (n, v) in enumerate(own)]
            counted = scored.agg(*before).first()
            known |= {n: counted[f"r{i}"] for i, (n, _) in enumerate(own)}
        if by == "cosine":
            values = dict(head) | dict(own)
        ranks.append(known)
    share = lambda at: 0.0 if at is None else 1 / (RRF + at)
    rows = [(n, share(ranks[0].get(n)) + share(ranks[1].get(n)), float(values.get(n, 0.0))) for n in wanted]
    kind = dense.schema["node_id"].dataType.simpleString()
    return dense.sparkSession.createDataFrame(rows, f"node_id {kind}, score double, cosine double")


def top(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The ``k`` best, ties to the smaller id; each task keeps k rows."""
    return scored.orderBy(F.col(by).desc(), "node_id").limit(k)


def overfetched(scored: DataFrame, visible: Column, k: int, by: str = "score") -> DataFrame:
    """Of the 2k best those that are visible, k at most; it can be fewer though more are visible."""
    return top(top(scored, 2 * k, by).where(visible), k, by)


def enumerated(hits: DataFrame, least: float, visible: Column, most: int = 120, start_col: str = "t_start") -> DataFrame:
    """Threshold listing: of the 3 * ``most`` best (node_id, cosine, ...) those of ``least`` or more
    (unless no hit has a cosine), visible, one an id, in time order; ids without a time last."""
    cap = min(most, 300)
    got = top(hits, 3 * cap, "cosine")
    got = got.withColumn("cosine", F.round("cosine", 4))
    got = got.where((F.col("cosine") >= least) | ~F.lit(got.where("cosine != 0").limit(1).count() > 0)).where(visible)
    one = got.groupBy("node_id").agg(F.max_by(F.struct(*[c for c in got.columns if c != "node_id"]), "cosine").alias("x")).select("node_id", "x.*")
    return top(one, cap, "cosine").orderBy(F.col(start_col).asc_nulls_last(), "node_id")
