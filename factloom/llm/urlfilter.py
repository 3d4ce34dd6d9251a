"""URL filters: fixed rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host, registered domain and suffix. Each level's bad rates are shrunk towards
those of the level above: a child's prior is a beta distribution around its parent's posterior mean, as strong as the
beta-binomial law of all children of that level says (method of moments: what the counts scatter beyond binomial
chance). A host is blocked where the lower bound of its posterior bad rate reaches BAD. All counts, strengths and
posteriors are DataFrame columns; what the driver gets is nothing.

Defined cases: a null url, or one without "://", has empty host and path and no rule; its outcomes count for no host
and it is allowed. An outcome is one row for each page_id that the labels know; contradicting labels of one page count
as bad, labels whose marks are all null are none. Rows without page_id are judged like others but carry no outcome.
Pages that repeat are judged, and counted as outcomes, row by row. Extra columns do no harm; result names win.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A host is blocked where its bad rate is at least BAD, with all but the lower tail of Z standard deviations.
BAD, Z = 0.5, 1.6448536269514722
#: Prior of the whole: one good and one bad page. Least and largest strength of a level's prior, in pages.
WHOLE, WEAKEST, STRONGEST = (1.0, 1.0), 1.0, 1e6
PLACES = 9
# Rules (verdict, host, path) of op13; suffixes of more than one label.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUFFIXES = ("ac.jp", "ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and / ? # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def suffix_of(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column) -> Column:
    """The suffix and one label before it; the name itself where it has no more."""
    return F.when(F.substring_index(name, ".", -2).isin(*SUFFIXES), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; of equally long ones the one of the longer host, then the first. Null if none fits.

    rules: a bounded list of (verdict, host, path); each becomes one condition.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    if not order:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in order]
    pick = lambda values: reduce(lambda c, x: c.when(x[0], x[1]), list(zip(fits, values, strict=True))[1:], F.when(fits[0], values[0]))
    return pick([h + p for _, h, p in order]), pick([v for v, _, _ in order])


def outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad) of labelled pages, one row each: bad if of low quality or toxic by any label."""
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return known.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad.cast("long")).alias("bad"))


def strength(children: DataFrame, name: str) -> DataFrame:
    """One row: how many pages the prior of a level counts as. children: n, bad and mean, the parent's rate, of each child."""
    n, m = F.col("n").cast("double"), F.col("mean")
    var = m * (1 - m)
    sums = children.agg(F.sum((F.col("bad") - n * m) ** 2 - n * var).alias("over"), F.sum(n * (n - 1) * var).alias("pairs"))
    rho = F.round(F.coalesce(F.col("over") / F.nullif(F.col("pairs"), F.lit(0.0)), F.lit(0.0)), PLACES)
    return sums.select(F.least(F.greatest(1 / F.nullif(F.greatest(rho, F.lit(0.0)), F.lit(0.0)) - 1, F.lit(WEAKEST)), F.lit(STRONGEST)).alias("s")).select(F.coalesce("s", F.lit(STRONGEST)).alias(name))


def shrunk(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """children with mean, the prior's mean, strength and rate, the posterior mean, given their parents' rates."""
    met = children.join(parents.select(parent, F.col("rate").alias("mean")), parent)
    met = met.crossJoin(F.broadcast(strength(met, "strength")))  # one row
    return met.withColumn("rate", F.round((F.col("bad") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength")), PLACES))


def reputations(pages: DataFrame) -> DataFrame:
    """(host, n, bad, prior_mean, prior_strength, rate, bound) of each host. pages: (host, bad), bad null where a page has no label.

    Counts meet their parents level by level, so that work after the first aggregate grows with hosts, not pages. A
    host's prior holds its own outcomes through its domain, as is usual in empirical Bayes.
    """
    name = name_of(F.col("host"))
    counted = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = common.written(counted.select("host", "n", "bad", domain_of(name).alias("domain"), suffix_of(name).alias("suffix")).where("host <> ''"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.round((F.coalesce(F.sum("bad"), F.lit(0)) + WHOLE[0]) / (F.coalesce(F.sum("n"), F.lit(0)) + WHOLE[0] + WHOLE[1]), PLACES).alias("mean"))
    first = suffixes.crossJoin(F.broadcast(whole))  # one row
    first = first.crossJoin(F.broadcast(strength(first, "strength")))
    first = first.withColumn("rate", F.round((F.col("bad") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength")), PLACES))
    last = shrunk(hosts, shrunk(domains, first, "suffix"), "domain")
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return last.select("host", "n", "bad", F.col("mean").alias("prior_mean"), F.round("strength", PLACES).alias("prior_strength"), "rate", F.round(F.col("rate") - Z * sd, PLACES).alias("bound"))


def judged(pages: DataFrame, labelled: DataFrame, rules=RULES, bad_rate: float = BAD) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_bound of each page (page_id, url); labelled: from outcomes().

    The rule decides where one fits; else the page is blocked if its host's bound is at least bad_rate.
    """
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = common.written(reputations(parts.select("page_id", "host").join(labelled, "page_id", "left").select("host", "bad")), "reputations")
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    met = parts.join(known.select("host", F.col("rate").alias("bad_rate"), F.col("bound").alias("bad_bound")), "host", "left")
    method = F.when(F.col("bad_bound") >= bad_rate, "block").otherwise("allow")
    return met.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "bad_rate", "bad_bound")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by its url; outcomes are the labels whose id is the page's."""
    return judged(common.table(spark, sf_dir, "pages"), outcomes(common.table(spark, sf_dir, "labels")))


def strength_sql(children: str) -> str:
    rho = f"(SELECT round(coalesce(sum((bad - n * mean) ** 2 - n * mean * (1 - mean)) / nullif(sum(n::double * (n - 1) * mean * (1 - mean)), 0), 0), {PLACES}) FROM {children})"
    return f"coalesce(least(greatest(1 / nullif(greatest({rho}, 0), 0) - 1, {WEAKEST}), {STRONGEST}), {STRONGEST})"


def op13_sql() -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in order]
    rule = "CASE " + " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, order, strict=True)) + " END"
    says = "CASE " + " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, order, strict=True)) + " END"
    two = "array_to_string(string_split(name, '.')[-2:], '.')"
    known = f"{two} IN ({', '.join(repr(s) for s in SUFFIXES)})"
    post = lambda s: f"round((bad + {s} * mean) / (n + {s}), {PLACES})"
    return f"""
WITH p AS MATERIALIZED (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::bigint) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY ALL),
c AS (SELECT host, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS name, count(bad)::double AS n, coalesce(sum(bad), 0)::double AS bad FROM p LEFT JOIN o USING (page_id) WHERE host <> '' GROUP BY ALL),
h AS MATERIALIZED (SELECT host, n, bad, CASE WHEN {known} THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE {two} END AS domain, CASE WHEN {known} THEN {two} ELSE string_split(name, '.')[-1] END AS suffix FROM c),
d AS MATERIALIZED (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS MATERIALIZED (SELECT suffix, sum(n) AS n, sum(bad) AS bad, round((sum(sum(bad)) OVER () + {WHOLE[0]}) / (sum(sum(n)) OVER () + {sum(WHOLE)}), {PLACES}) AS mean FROM d GROUP BY suffix),
sr AS MATERIALIZED (SELECT suffix, {post('z')} AS rate FROM (SELECT *, {strength_sql('s')} AS z FROM s)),
dm AS MATERIALIZED (SELECT d.*, sr.rate AS mean FROM d JOIN sr USING (suffix)), dr AS MATERIALIZED (SELECT domain, {post('z')} AS rate FROM (SELECT *, {strength_sql('dm')} AS z FROM dm)),
hm AS MATERIALIZED (SELECT h.*, dr.rate AS mean FROM h JOIN dr USING (domain)), hr AS (SELECT *, {post('z')} AS rate FROM (SELECT *, {strength_sql('hm')} AS z FROM hm)),
b AS (SELECT host, rate AS bad_rate, round(rate - {Z} * sqrt(rate * (1 - rate) / (n + z + 1)), {PLACES}) AS bad_bound FROM hr)
SELECT page_id, host, path, {rule} AS rule, coalesce({says}, CASE WHEN bad_bound >= {BAD} THEN 'block' ELSE 'allow' END) AS verdict, bad_rate, bad_bound FROM p LEFT JOIN b USING (host)
"""
