"""URL filter: written rules first, then the reputation of the host by empirical Bayes.

A rule names a host and the start of a path; it fits its host and all subdomains, and the longest
fitting rule decides (of two of one length that with the longer host, then the one that blocks).

Pages without a rule go by their host. A labelled page is an outcome, good or not. The share of good
pages is shrunk down the levels suffix, registered domain, host: each level's share is a beta prior
around its parent's share, whose strength comes from the spread of the level's children around their
parents (beta-binomial moments, pooled over parents). So a host without outcomes has its domain's share
and a wide interval, and one with many has its own. A host is blocked if even the upper bound of its
share, mean + z standard deviations of the posterior, is under ``least_good``.

Without ``outcomes`` the pages that a rule decides are the labelled ones, good where it allows. A host
counts here without user, port and last dot; a suffix is the last label, or two of ``suffixes``; an
address is its own domain and suffix.

One host or domain may hold most rows: counts combine before their shuffles, and in joins keys with over
a thousandth of all rows (under a thousand of them, so they may be broadcast) are joined apart from the rest.

Defined cases: a null url or one without ``://`` has an empty host and path, whose share is that of all
outcomes; null and repeated ids give a row each; without outcomes every share is even and nothing is
blocked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import join_apart, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Strength of a prior where no parent has two children to tell it, and its limits.
STRENGTH, WEAKEST, STRONGEST = 10.0, 1.0, 1000.0


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _ranked(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(verdict, host, path) of rules like ("block", "example.org/es/"), the first that fits decides."""
    split = [(v, *r.partition("/")) for v, r in rules]
    bad = [v for v, *_ in split if v not in ("allow", "block")]
    if bad:
        raise ValueError(f"a rule allows or blocks, not: {bad}")
    return sorted(((v, h.translate(str.maketrans(UPPER, LOWER)), slash + p) for v, h, slash, p in split), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] == "allow"))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that decides, as text, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in reversed(_ranked(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def levels(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column, Column]:
    """Host without user, port and last dot; its registered domain; its suffix."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")
    address = bare.rlike(r"^[0-9.]+$|[\[:]")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(*suffixes) if suffixes else F.lit(False)
    suffix = F.when(address, bare).when(long, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(address, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    return bare, domain, suffix


def _strength(children: DataFrame, parent: str) -> float:
    """Of the prior that holds ``children`` (parent, n, s) to their parents' shares: 1 / rho - 1, where rho is
    the part of the spread within parents that chance doesn't explain."""
    of = children.where("n > 0").groupBy(parent).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("s").cast("double") * F.col("s") / F.col("n")).alias("ss"))
    share = F.col("s") / F.col("n")
    chance = share * (1 - share)
    one = of.agg(
        F.sum(F.col("ss") - F.col("s").cast("double") * F.col("s") / F.col("n") - chance * (F.col("k") - 1)).alias("over"),
        F.sum(chance * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1))).alias("room"),
    ).first()
    if not one["room"] or one["room"] <= 1e-9:
        return STRENGTH
    rho = min(max(one["over"] / one["room"], 1 / (STRONGEST + 1)), 1 / (WEAKEST + 1))
    return round(1 / rho - 1, 6)


def host_shares(seen: DataFrame, z: float = 1.645, suffixes: Sequence[str] = ()) -> DataFrame:
    """(bare, rows, n, s, share, bound): each host's posterior share of good pages and its upper bound.

    ``seen``: a row a page with ``host`` and ``good`` (null: not labelled).
    """
    bare, domain, suffix = levels(F.col("host"), suffixes)
    hosts = seen.groupBy("host").agg(F.count("*").alias("rows"), F.count("good").alias("n"), F.sum(F.coalesce(F.col("good").cast("long"), F.lit(0))).alias("s"))
    hosts = store(hosts.select(bare.alias("bare"), domain.alias("domain"), suffix.alias("suffix"), "rows", "n", "s").groupBy("bare", "domain", "suffix").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "s")]), "hosts")
    domains = store(hosts.groupBy("domain", "suffix").agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("s").alias("s")), "domains")
    tops = store(domains.groupBy("suffix").agg(F.count("*").alias("domains"), F.sum("n").alias("n"), F.sum("s").alias("s")), "suffixes")
    every = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("domains"), F.lit(0)).alias("domains")).first()
    n_hosts = domains.agg(F.coalesce(F.sum("hosts"), F.lit(0)).alias("n")).first()["n"]
    mean = (every["s"] + 1) / (every["n"] + 2)
    m_top, m_domain, m_host = _strength(tops.withColumn("all", F.lit(0)), "all"), _strength(domains, "suffix"), _strength(hosts, "domain")

    tops = tops.select("suffix", "domains", ((F.lit(m_top * mean) + F.col("s")) / (F.lit(m_top) + F.col("n"))).alias("top_share"))
    domains = join_apart(domains, "suffix", tops, every["domains"], "domains", F.lit(True))
    domains = domains.select("domain", "hosts", ((F.lit(m_domain) * F.col("top_share") + F.col("s")) / (F.lit(m_domain) + F.col("n"))).alias("domain_share"))
    hosts = join_apart(hosts, "domain", domains, n_hosts, "hosts", F.lit(True))
    a = F.lit(m_host) * F.col("domain_share") + F.col("s")
    b = F.lit(m_host) * (1 - F.col("domain_share")) + (F.col("n") - F.col("s"))
    hosts = hosts.withColumn("a", a).withColumn("b", b).withColumn("share", F.col("a") / (F.col("a") + F.col("b")))
    spread = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("a") + F.col("b") + 1))
    return hosts.select("bare", "rows", "n", "s", "share", (F.col("share") + F.lit(z) * spread).alias("bound"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], outcomes: DataFrame | None = None, least_good: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) of every url; ``bound`` is null where a rule decides, or
    where the host isn't blocked.

    ``outcomes`` (page_id, good boolean), one row a page: takes the place of the rules' verdicts as labels.
    """
    own = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rule, by_rule = rule_columns(F.col("host"), F.col("path"), rules)
    own = own.select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"))
    if outcomes is None:
        seen = own.select("host", (F.col("by_rule") == "allow").alias("good"))
    else:
        seen = own.join(outcomes.select(F.col("page_id"), F.col("good").cast("boolean").alias("good")), "page_id", "left").select("host", "good")
    shares = host_shares(seen, z, suffixes)
    blocked = store(shares.where(F.col("bound") < least_good).select("bare", "rows", "bound"), "blocked")
    total = shares.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    own = own.withColumn("bare", levels(F.col("host"), suffixes)[0])
    out = join_apart(own, "bare", blocked, total, "rows", F.col("rule").isNull())
    bound = F.when(F.col("rule").isNull(), F.col("bound"))
    verdict = F.coalesce("by_rule", F.when(F.col("bound").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), bound.alias("bound"))
