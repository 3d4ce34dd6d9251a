"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only.

Kinds in order. The first four are the base: they stay whatever their score. The rest are kept at a score of 0.5 or more.

email, ip (each part at most 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits), iban (mod 97), ssn (needs
a word nearby). Matches are leftmost and non-overlapping within a kind; a match that fails its test is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
#: The patterns in plain form, as SQL engines without look-behind take them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9](\x20?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: The same matches without backtracking: a run of characters is tried from its start only, or from the last match's end.
FAST = PLAIN | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "iban": r"[A-Z][A-Z][0-9][0-9](?:\x20?+[A-Z0-9]){11,30}+",
}
#: Score before and after a word of the kind is found within NEAR characters of a span.
SCORE = {"email": (0.9, 0.95), "ip": (0.6, 0.8), "card": (0.8, 0.95), "phone": (0.7, 0.9), "iban": (0.9, 0.95), "ssn": (0.3, 0.8)}
NEAR = 40
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social", "security"),
}
CHUNK = 256


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(number)

    def term(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97."""
    packed = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, acc * 10 + c - 48).otherwise(acc * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def passes(kind: str, hit: Column) -> Column:
    number = digits(hit)
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(8, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34), mod97(hit)).otherwise(False)
    return F.lit(True)


def sums_before(values: Column) -> Column:
    """For each entry the sum of those before it; long arrays are taken in chunks, so that the work stays in proportion."""

    def prefix(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    starts = prefix(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.zip_with(parts, starts, lambda p, s: F.when(p.isNull(), F.array().cast("array<int>")).otherwise(F.slice(prefix(p, s), F.lit(1), F.size(p)))))


def may_hold(kind: str, text: str) -> Column:
    """A cheap test that every text with a match passes."""
    if kind in ("email", "phone"):
        return F.contains(F.col(text), F.lit("@" if kind == "email" else "+"))
    return F.col(text).rlike("[0-9]")


def score(kind: str, before: Column, after: Column) -> Column:
    """The kind's score, raised where one of its words stands within NEAR characters before or after, up to the next match of the kind."""
    around = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
    return F.when(around.rlike("|".join(WORDS[kind])), SCORE[kind][1]).otherwise(SCORE[kind][0])


def keeps(kind: str, hit: Column, before: Column, after: Column) -> Column:
    return passes(kind, hit) if kind in KINDS[:BASE] else passes(kind, hit) & (score(kind, before, after) >= 0.5)


def proposed(docs: DataFrame, text: str) -> DataFrame:
    """docs with __hits_<kind>, the matches, __gaps_<kind>, what stands between them, and __lens_<kind>, from measured()."""
    for kind in KINDS:
        docs = docs.withColumn(f"__hits_{kind}", F.when(may_hold(kind, text), F.regexp_extract_all(text, F.lit(FAST[kind]), 0)))
    for kind in KINDS:
        docs = docs.withColumn(f"__gaps_{kind}", F.when(F.size(f"__hits_{kind}") > 0, F.split(F.col(text), FAST[kind], -1)))
    for kind in KINDS:
        docs = docs.withColumn(f"__lens_{kind}", F.when(F.size(f"__hits_{kind}") > 0, measured(kind)))
    return docs


def measured(kind: str) -> Column:
    """Length of each gap and the match after it."""
    hits, gaps = F.col(f"__hits_{kind}"), F.col(f"__gaps_{kind}")
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))


def spans_of(kind: str) -> Column:
    """array<struct<start, stop, score, ok>> of one kind, from proposed(); null where there is no match."""
    hits, gaps = F.col(f"__hits_{kind}"), F.col(f"__gaps_{kind}")
    n = F.size(hits)
    zipped = F.arrays_zip(hits.alias("hit"), sums_before(F.col(f"__lens_{kind}")).alias("at"), F.slice(gaps, F.lit(1), n).alias("before"), F.slice(gaps, F.lit(2), n).alias("after"))

    def span(z: Column) -> Column:
        hit, before, after = z["hit"], z["before"], z["after"]
        start = z["at"] + F.length(before)
        return F.struct(start.alias("start"), (start + F.length(hit)).alias("stop"), score(kind, before, after).alias("score"), keeps(kind, hit, before, after).alias("ok"))

    return F.when(n > 0, F.filter(F.transform(zipped, span), lambda s: s["ok"]))


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with spans_<kind> of each kind, an array of (start, stop, score, ok) in code points, stop exclusive.

    A null text counts as empty: no spans. Overlaps between kinds stay. Equal rows give equal results. A column of
    docs that has the name of a new one gives way to it.
    """
    new = {f"spans_{k}" for k in KINDS}
    old = [F.col(f"`{c}`") for c in docs.columns if c not in new and c != "__text"]
    found = proposed(docs.select(*old, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text")), "__text")
    empty = F.array().cast("array<struct<start:int,stop:int,score:double,ok:boolean>>")
    return found.select(*old, *[F.coalesce(spans_of(k), empty).alias(f"spans_{k}") for k in KINDS])


def said(kind: str) -> Column:
    """array<string> of kind:start:stop."""
    return F.transform(f"spans_{kind}", lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")))


def joined(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.concat(*map(said, kinds)), ",")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every confirmed span of text replaced by its kind in brackets, kind after kind in order, each on the text the one before left.

    Null and empty texts stay as they are.
    """
    for kind in KINDS:
        docs = masked_kind(docs, text, kind)
    return docs


def masked_kind(docs: DataFrame, text: str, kind: str) -> DataFrame:
    hits, gaps = F.col("__hits"), F.col("__gaps")
    found = docs.withColumn("__hits", F.when(may_hold(kind, text), F.regexp_extract_all(text, F.lit(FAST[kind]), 0)))
    found = found.withColumn("__gaps", F.when(F.size("__hits") > 0, F.split(F.col(text), FAST[kind], -1)))

    def put(z: Column) -> Column:
        return F.concat(z["before"], F.when(keeps(kind, z["hit"], z["before"], z["after"]), F.lit(f"[{kind.upper()}]")).otherwise(z["hit"]))

    zipped = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("before"), F.slice(gaps, F.lit(2), F.size(hits)).alias("after"))
    made = F.concat(F.array_join(F.transform(zipped, put), ""), F.element_at(gaps, -1))
    return found.withColumn(text, F.when(F.size("__hits") > 0, made).otherwise(F.col(text))).drop("__hits", "__gaps")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the digest columns: scores, of every span in the order of spans, in hundredths."""
    found = detected(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    counts = [F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:BASE]]
    scores = F.concat(*[F.transform(f"spans_{k}", lambda s: F.round(s["score"] * 100).cast("int").cast("string")) for k in KINDS])
    return found.select("doc_id", *counts, F.sha2(joined(KINDS[:BASE]), 256).alias("base_sha256"), joined(KINDS).alias("spans"), F.array_join(scores, ",").alias("scores"))


def op8_sql() -> str:
    """The same rows in DuckDB's SQL."""
    hits = ", ".join(f"regexp_extract_all(t, '{PLAIN[k]}') AS h_{k}, regexp_split_to_array(t, '{PLAIN[k]}') AS g_{k}" for k in KINDS)
    number = "regexp_replace(h, '[^0-9]', '', 'g')"
    packed = "replace(h, ' ', '')"
    turned = f"(substr({packed}, 5) || substr({packed}, 1, 4))"
    test = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(h, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(CASE WHEN length(ltrim(p, '0')) <= 3 THEN ltrim(p, '0') END AS integer), 0) <= 255))",
        "card": f"CASE WHEN length({number}) BETWEEN 16 AND 19 THEN list_sum(list_transform(range(0, length({number})), lambda j: CASE WHEN j % 2 = 0 THEN cast(substr({number}, length({number}) - j, 1) AS integer) ELSE cast(substr({number}, length({number}) - j, 1) AS integer) * 2 - CASE WHEN cast(substr({number}, length({number}) - j, 1) AS integer) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 ELSE false END",
        "phone": f"length({number}) BETWEEN 8 AND 15",
        "iban": f"CASE WHEN length({packed}) BETWEEN 15 AND 34 THEN list_reduce(list_prepend(0, list_transform(range(1, length({turned}) + 1), lambda j: ascii(substr({turned}, j, 1)))), lambda a, c: CASE WHEN c < 58 THEN a * 10 + c - 48 ELSE a * 100 + c - 55 END % 97) = 1 ELSE false END",
        "ssn": "true",
    }
    parts = []
    for k in KINDS:
        near = f"regexp_matches(lower(right(g_{k}[i], {NEAR}) || ' ' || left(g_{k}[i + 1], {NEAR})), '{'|'.join(WORDS[k])}')"
        keep = "true" if k in KINDS[:BASE] else f"CASE WHEN {near} THEN {SCORE[k][1]} ELSE {SCORE[k][0]} END >= 0.5"
        lens = f"list_transform(range(1, len(h_{k}) + 1), lambda j: length(g_{k}[j]) + length(h_{k}[j]))"
        start = f"(coalesce(list_sum(list_slice(l_{k}, 1, i - 1)), 0) + length(g_{k}[i]))"
        said = f"'{k}:' || cast({start} AS bigint) || ':' || cast({start} + length(h_{k}[i]) AS bigint)"
        ok = test[k].replace("h,", f"h_{k}[i],").replace("(h)", f"(h_{k}[i])")
        able = f"list_filter(range(1, len(h_{k}) + 1), lambda i: {keep} AND {ok})"
        score = f"CASE WHEN {near} THEN '{round(SCORE[k][1] * 100)}' ELSE '{round(SCORE[k][0] * 100)}' END"
        parts.append((lens, f"list_transform({able}, lambda i: {said}) AS s_{k}, list_transform({able}, lambda i: {score}) AS p_{k}"))
    lens = ", ".join(f"{p[0]} AS l_{k}" for k, p in zip(KINDS, parts, strict=True))
    counts = ", ".join(f"cast(len(s_{k}) AS bigint) AS n_{k}" for k in KINDS[:BASE])
    base, every = (" || ".join(f"s_{k}" for k in kinds) for kinds in (KINDS[:BASE], KINDS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, {hits} FROM d),
l AS (SELECT *, {lens} FROM h),
s AS (SELECT doc_id, {', '.join(p[1] for p in parts)} FROM l)
SELECT doc_id, {counts}, sha256(array_to_string({base}, ',')) AS base_sha256, array_to_string({every}, ',') AS spans, array_to_string({' || '.join(f"p_{k}" for k in KINDS)}, ',') AS scores FROM s
"""
