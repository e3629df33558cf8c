"""Personal data in texts, with Spark SQL functions only.

Regular expressions propose spans, checksum validators confirm them (Luhn for cards, mod 97 for
IBANs), words nearby adjust the score, and a span is kept from ``THRESHOLD`` on. The base kinds
(email, ip, card, phone) are kept whenever their own rule holds. The method adds three kinds:

* ``iban``: a country's two letters and as many digits and letters as its accounts have, in groups or not;
  the mod-97 check must hold.
* ``ssn``: three, two and four digits joined by hyphens; no checksum, so only a context word within
  ``CONTEXT_CHARS`` before or after it lifts the score to the threshold.
* ``secret``: keys with a known prefix, and 32 to 64 hexadecimal digits that hold digits and letters; the
  latter need a context word too.

Proposed spans of one kind are the leftmost non-overlapping matches. Positions are code points, end
exclusive. They come from the text between the matches: a match starts after the lengths of all
pieces and matches before it. Patterns are written with possessive repeats and start guards that
change no match but keep the time linear and the stack flat on very long texts.

Defined cases: a null or empty text has no spans; null and repeated ids give a row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import fresh, two

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
#: Account lengths by country (fixed values).
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
    "GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 "
    "PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20"
).split()
IBAN = "|".join(f"(?:{'|'.join(x[:2] for x in IBAN_LENGTHS if x[2:] == n)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{int(n) - 4}}}" for n in sorted({x[2:] for x in IBAN_LENGTHS}))
KNOWN_KEYS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64}"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9_])(?:{IBAN})(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
    "secret": rf"(?<![A-Za-z0-9_])(?:{KNOWN_KEYS}|[A-Fa-f0-9]{{32,64}})(?![A-Za-z0-9_])",
}
#: A text without this can't match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT_CHARS = 40
CONTEXT = {
    "email": r"(?i)(?<![A-Za-z0-9_])(?:e-?mail|mail|contact)(?![A-Za-z0-9_])",
    "ip": r"(?i)(?<![A-Za-z0-9_])(?:ip|address|host|server)(?![A-Za-z0-9_])",
    "card": r"(?i)(?<![A-Za-z0-9_])(?:card|credit|visa|payment)(?![A-Za-z0-9_])",
    "phone": r"(?i)(?<![A-Za-z0-9_])(?:phone|tel|call|mobile|fax)(?![A-Za-z0-9_])",
    "iban": r"(?i)(?<![A-Za-z0-9_])(?:iban|bank|account|konto)(?![A-Za-z0-9_])",
    "ssn": r"(?i)(?<![A-Za-z0-9_])(?:ssn|social|security|insurance)(?![A-Za-z0-9_])",
    "secret": r"(?i)(?<![A-Za-z0-9_])(?:token|secret|password|passwd|credential|key|api_?key|access_?key|auth)(?![A-Za-z0-9_])",
}
#: Score of a confirmed span, what a context word adds, and the least score that is kept.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
CONTEXT_ADDS = 0.3
THRESHOLD = 0.5
#: Spans that are put into one array at a time: a longer list is a list of such arrays, so time stays linear.
CHUNK = 200


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass Luhn's check: from the right every second one is doubled."""
    # a reversed copy makes the places even and odd from the right
    back = F.filter(F.split(F.reverse(digits_of(match)), ""), lambda d: d != "").cast("array<int>")
    worth = F.transform(back, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an IBAN's check digits hold: the first four go last, letters count from 10."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    codes = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.ascii(c))
    rest = F.aggregate(codes, F.lit(0), lambda a, c: F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97))
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        # leading zeros aside, three digits at most and 255 at most
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        # the length first: only matches of 14 to 37 characters can have 14 to 19 digits
        n = F.length(digits_of(match))
        return F.when(F.length(match).between(14, 37), F.when(n.between(14, 19), luhn(match)).otherwise(False)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(match)).between(10, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def in_chunks(items: Column) -> Column:
    """An array as an array of arrays of CHUNK items at most."""

    def cut(x: Column) -> Column:
        n = F.ceil(F.size(x) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK)))

    # in a list of one, so that the array is made once and not for every chunk
    return F.element_at(F.transform(F.array(items), cut), 1)


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<start, kind_no, kind, end, score>> of the kind's kept spans, in order."""
    n = KINDS.index(kind)
    none = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,score:double>>")
    pieces, matches = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    # starts[i]: the length of pieces 0..i and matches 0..i-1
    lengths = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m"), F.substr(p, F.greatest(F.length(p) - CONTEXT_CHARS + 1, F.lit(1))).alias("before")))
    later = F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1)))
    lengths = F.zip_with(lengths, later, lambda x, p: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), x["before"].alias("before"), F.substring(p, 1, CONTEXT_CHARS).alias("after")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        base = F.when(x["m"].rlike(f"^(?:{KNOWN_KEYS})$"), 0.8).otherwise(SCORE[kind]) if kind == "secret" else F.lit(SCORE[kind])
        score = base + F.when(x["before"].rlike(CONTEXT[kind]) | x["after"].rlike(CONTEXT[kind]), CONTEXT_ADDS).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(n).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))
        keep = confirmed(kind, x["m"]) & (F.lit(kind in BASE) | (score >= THRESHOLD))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def chunk(acc, items):
        own = F.aggregate(items, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(own["at"].alias("at"), F.concat(acc["out"], F.array(own["out"])).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array(none).alias("out"))
    found = F.aggregate(in_chunks(F.filter(lengths, lambda x: x["m"].isNotNull())), zero, chunk, lambda acc: F.flatten(acc["out"]))
    could = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    return F.when(could & text.rlike(PATTERNS[kind]), found).otherwise(none)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): all kept spans by start, then kind; text is "" for null."""
    docs = two(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = docs.select("doc_id", "text", *(spans_of(F.col("text"), k).alias(k) for k in KINDS))
    return each.select("doc_id", "text", F.array_sort(F.concat(*KINDS)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    found = find_pii(df, id_col, text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first wins."""
    # each chunk of spans takes its part of the text once, so a place in it is found from near
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s, part, base):
        gap = F.substr(part, acc["at"] - base + 1, s["start"] - acc["at"])
        taken = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
        # an overlapping span only lengthens what is hidden
        merged = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(merged)

    def chunk(acc, items):
        part = F.substr(text, acc["at"] + 1, F.greatest(F.element_at(items, -1)["start"] - acc["at"], F.lit(0)))
        # the part stands in a list of one, so that it is cut out once for all of the chunk's spans
        own = F.element_at(F.transform(F.array(part), lambda p: F.aggregate(items, F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out")), lambda a, s: step(a, s, p, acc["at"]))), 1)
        return F.struct(own["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(own["out"], ""))).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(in_chunks(spans), first, chunk, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1))))


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in ``text_col`` masked; null texts stay null, other columns as they are."""
    whole, spans = fresh(df, "whole_text"), fresh(df, "pii_spans")
    marked = df.withColumn(whole, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    marked = marked.withColumn(spans, F.array_sort(F.concat(*(spans_of(F.col(whole), k) for k in KINDS))))
    hidden = F.when(F.col(text_col).isNotNull(), masked(F.col(whole), F.col(spans)))
    return marked.withColumn(text_col, hidden).drop(whole, spans)
