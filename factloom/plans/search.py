"""Queries over the document corpus: BM25 variants, fusion, replay and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import session
from factloom.functions import text as fx
from factloom.operators import fusion, lexical, metrics
from factloom.sources import tables


def tokens(text):
    return fx.benchmark_tokens(text)


def words(text):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)


def bm25_topk(spark, sf_dir, k: int = 10):
    return lexical.best(tables.corpus_queries(spark, sf_dir), tables.corpus(spark, sf_dir), fx.conversation_terms, k)


def bm25_repeat_boost(spark, sf_dir, k: int = 10):
    return lexical.best(tables.corpus_queries(spark, sf_dir), tables.corpus(spark, sf_dir), tokens, k, boosted=True)


def bm25_allowed_topk(spark, sf_dir, k: int = 10):
    """Only documents of the label 1 may be returned; statistics are those of all. The search reads what its bounds cannot rule out."""
    good = tables.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("doc"))
    index = lexical.indexed(tables.corpus(spark, sf_dir), tokens)
    return lexical.pruned(tables.corpus_queries(spark, sf_dir), index, tokens, k, boosted=True, allowed=good).rows


def bm25_code_scores(spark, sf_dir):
    """Single-precision scores over letter runs, where the code tokeniser and a plain one agree, by query the sum and number."""
    scores = lexical.bm25_float(tables.corpus_queries(spark, sf_dir), tables.corpus(spark, sf_dir), words)
    return scores.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max(F.col("score").cast("double")), 3).alias("best"))


def scores(spark, sf_dir):
    """All scores of two rankings of the corpus, written once: boosted BM25 and plain BM25 on stems."""
    q, d = tables.corpus_queries(spark, sf_dir), tables.corpus(spark, sf_dir)
    return [session.written(s.select("query_id", "doc", "score"), "scores") for s in (lexical.bm25_boosted(q, d, tokens), lexical.bm25(q, d, fx.conversation_terms))]


def channels(spark, sf_dir, k: int):
    """The first k of both rankings, written once."""
    q, d = tables.corpus_queries(spark, sf_dir), tables.corpus(spark, sf_dir)
    return [session.written(lexical.best(q, d, t, k, boosted), "ranks") for t, boosted in ((tokens, True), (fx.conversation_terms, False))]


def rrf_fusion(spark, sf_dir, k: int = 10):
    return fusion.fused_top(scores(spark, sf_dir), [1.0, 0.5], 60, k)


def signal_ablation(spark, sf_dir):
    """Five channels over the fused candidates, replayed with and without the lexical one."""
    a, b = scores(spark, sf_dir)
    first = session.written(fusion.fused_top([a, b], [1.0, 0.5], 60, 10), "fused").select("query_id", F.col("doc").alias("id"), F.col("doc").alias("corpus_order"), F.col("rank").alias("found"))
    # few of all scores are asked for, so these are taken out before the join
    known = a.select("query_id", F.col("doc").alias("id"), F.col("score").alias("lexical")).join(first.select("query_id", "id"), ["query_id", "id"], "left_semi")
    value = first.join(known, ["query_id", "id"], "left").select("*", (F.col("id") % 7).alias("frequency"), (F.col("id") % 5).alias("degree"), (F.col("id") % 3).alias("overlap"))
    value = value.withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    ranked = fusion.channel_ranks(value, {"structural_order": "found", "bm25": "lexical", "edge_frequency": "frequency", "graph_degree": "degree", "id_overlap": "overlap"})
    rows = fusion.explained(ranked, "callers")
    full = fusion.replayed(rows).select("query_id", "id", F.col("rank").alias("full_rank"), F.col("score").alias("full_score"))
    less = fusion.replayed(rows, ("bm25",)).select("query_id", "id", F.col("rank").alias("ablated_rank"))
    return full.join(less, ["query_id", "id"])


def graded(spark, sf_dir):
    """Both rankings' first five with gold documents: those of label 1 that hold a seventh of the ids' query."""
    a, b = channels(spark, sf_dir, 5)
    runs = a.withColumn("profile", F.lit("boosted")).unionByName(b.withColumn("profile", F.lit("plain")))
    ids = runs.groupBy("query_id", "profile").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("ids"))
    gold = a.where("rank <= 3").join(tables.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("doc")), "doc", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list("doc")).alias("gold"))
    rows = ids.join(gold, "query_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<bigint>")))
    return metrics.retrieval_metrics(rows).withColumn("question_id", F.col("query_id")).withColumn("category", (F.col("query_id") % 4).cast("string")).withColumn("conversation", (F.col("query_id") % 3).cast("string"))


def hit_recall_mrr(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return graded(spark, sf_dir).select("query_id", "profile", "hit", r("recall"), r("mrr"), "full_evidence")


def grouping_report(spark, sf_dir):
    return metrics.grouped_report(graded(spark, sf_dir))


def paired_wins(spark, sf_dir):
    return metrics.paired(graded(spark, sf_dir), ["hit", "mrr"], "plain", ["boosted"])


def percentiles(spark, sf_dir):
    return metrics.percentiles(tables.table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])


def confusion(spark, sf_dir):
    """Labels against a length rule, by source."""
    rows = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("expected"), (F.col("n_chars") >= 1000).alias("found"))
    out = metrics.confusion(rows, "source")
    return out.select("source", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def category_summary(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in metrics.WEIGHTS])
    rows = tables.table(spark, sf_dir, "documents").select(F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("category"), F.when(F.col("n_chars") > 800, 1.0).otherwise(0.25).alias("score"))
    out = metrics.category_summary(rows)
    return out.select("category", "n", "passed", F.round("average", 6).alias("average"), F.round("weighted", 6).alias("weighted"))


def expected_scores(spark, sf_dir):
    """The four kinds of expectation over orders' line items; wanted are the parts that 3 divides and one more that may not be there."""
    item = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("returned"))
    kind = F.element_at(fx.strings(["exact_symbol", "in_top_k", "contains", "exact_set"]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    want = F.array_union(F.filter("returned", lambda p: p % 3 == 0), F.array(F.col("l_orderkey") % 50 + 1))
    score = metrics.expected_score(kind, F.col("returned"), F.element_at("returned", -1), F.lit(2), want)
    return item.select(F.col("l_orderkey"), F.round(score, 6).alias("score"))


def cluster_bootstrap(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents").select(F.col("source").alias("cluster"), (F.col("n_chars") % 3 - 1).cast("double").alias("delta"))
    return metrics.cluster_bootstrap(spark, rows).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def token_statistics(spark, sf_dir):
    """How many tokens the tokenisers find in each document."""
    t = F.col("text")
    return tables.corpus(spark, sf_dir).select("doc", F.size(fx.conversation_terms(t)).cast("long").alias("n_terms"), F.size(F.array_distinct(fx.conversation_terms(t))).cast("long").alias("n_distinct"), F.size(fx.benchmark_tokens(t)).cast("long").alias("n_tokens"), F.length(fx.normalised(t)).cast("long").alias("normalised_chars"))


def stage_diagnosis(spark, sf_dir):
    """Where the plain ranking loses the boosted one's first three: not a candidate, ranked late, first place lost, or found."""
    a, b = channels(spark, sf_dir, 20)
    replay = b.select("query_id", F.col("doc").alias("id"), "rank", (F.col("rank") <= 5).alias("selected"))
    gold = a.where("rank <= 3").select("query_id", F.col("doc").alias("id"), F.when(F.col("rank") == 1, "exact_symbol").otherwise("contains").alias("kind"), F.lit(None).cast("int").alias("k"))
    return fusion.stages(replay, gold).select("query_id", "id", "stage")


def run_completeness(spark, sf_dir):
    """Questions and profiles that a full run would have and this one lacks: queries of an odd id were run with one profile only."""
    q = tables.corpus_queries(spark, sf_dir).select(F.col("query_id").alias("question_id"))
    runs = q.withColumn("profile", F.explode(F.when(F.col("question_id") % 2 == 1, fx.strings(["plain"])).otherwise(fx.strings(["plain", "boosted"]))))
    return metrics.missing_runs(runs, q, ["plain", "boosted"])


STOP = ", ".join(f"'{w}'" for w in fx.BENCHMARK_STOP)
STOP1 = ", ".join(f"'{w}'" for w in fx.STOP)
IRREGULAR = " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in fx.IRREGULAR.items())
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({STOP}))"
TERMS = f"list_transform(list_filter(regexp_extract_all(lower(text), '[a-z]+|[0-9]+'), lambda w: w NOT IN ({STOP1})), lambda w: CASE {IRREGULAR} WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, length(w) - 3) WHEN length(w) > 4 AND w LIKE '%ed' THEN left(w, length(w) - 2) WHEN length(w) > 4 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END)"
WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
QUERY = "SELECT item_id AS query_id, text FROM benchmark"


def grouped_parts_sql(name: str, tokens: str, queries: str, docs: str) -> str:
    """As parts_sql, for documents and queries that a column g splits into collections with statistics of their own."""
    return f"""
{name}_d AS (SELECT g, doc, {tokens} AS toks FROM ({docs})), {name}_l AS (SELECT g, doc, len(toks) AS len FROM {name}_d),
{name}_w AS (SELECT g, count(*) AS total, coalesce(nullif(avg(len), 0), 1) AS mean FROM {name}_l GROUP BY ALL),
{name}_p AS (SELECT g, doc, term, count(*) AS tf FROM (SELECT g, doc, unnest(toks) AS term FROM {name}_d) GROUP BY ALL),
{name}_f AS (SELECT g, term, count(*) AS df FROM {name}_p GROUP BY ALL),
{name}_q AS (SELECT query_id, g, term, count(*) AS qtf, min(place) AS first FROM (SELECT query_id, g, unnest(toks) AS term, generate_subscripts(toks, 1) AS place FROM (SELECT query_id, g, {tokens} AS toks FROM ({queries}))) GROUP BY ALL),
{name} AS (SELECT query_id, doc, term, qtf, first, ln(1 + (total - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * (len / mean))) AS part
 FROM {name}_q JOIN {name}_p USING (g, term) JOIN {name}_f USING (g, term) JOIN {name}_l USING (g, doc) JOIN {name}_w USING (g))"""


def parts_sql(name: str, tokens: str, number: str = "double", queries: str = QUERY, docs: str = "SELECT doc_id AS doc, text FROM documents") -> str:
    """CTE name: query_id, doc, term, qtf, first, part."""
    n = lambda x: f"cast({x} AS {number})"
    return f"""
{name}_d AS (SELECT doc, {tokens} AS toks FROM ({docs})), {name}_l AS (SELECT doc, len(toks) AS len FROM {name}_d),
{name}_w AS (SELECT count(*) AS total, coalesce(nullif(avg(len), 0), 1) AS mean FROM {name}_l),
{name}_p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(toks) AS term FROM {name}_d) GROUP BY ALL),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY ALL),
{name}_q AS (SELECT query_id, term, count(*) AS qtf, min(place) AS first FROM (SELECT query_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS place FROM (SELECT query_id, {tokens} AS toks FROM ({queries}))) GROUP BY ALL),
{name} AS (SELECT query_id, doc, term, qtf, first, {n('ln(1 + (total - df + 0.5::double) / (df + 0.5::double))')} * ({n('tf')} * {n('2.2::double')}) / ({n('tf')} + {n('1.2::double')} * ({n('0.25::double')} + {n('0.75::double')} * ({n('len')} / {n('mean')}))) AS part
 FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_f USING (term) JOIN {name}_l USING (doc), {name}_w)"""


BOOST = parts_sql("b", TOKENS) + ", boosted AS (SELECT query_id, doc, round(list_reduce(list_prepend({'part': 0::double, 'qtf': 1::bigint}, list({'part': part, 'qtf': qtf} ORDER BY first)), lambda a, x: {'part': (a.part + x.part) * (1 + 0.05::double * least(x.qtf - 1, 2)), 'qtf': 1::bigint}).part, 6) AS score FROM b GROUP BY ALL)"
PLAIN = parts_sql("s", TERMS) + ", plain AS (SELECT query_id, doc, round(sum(part), 6) AS score FROM s GROUP BY ALL)"


def ranked(source: str, k: int | None, name: str) -> str:
    return f"{name} AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS integer) AS rank, doc, score FROM {source} {f'QUALIFY rank <= {k}' if k else ''})"


FUSE = f"{BOOST}, {PLAIN}, {ranked('boosted', None, 'ra')}, {ranked('plain', None, 'rb')}, fu AS (SELECT query_id, doc, round(list_reduce(list_prepend(0::double, list(p ORDER BY c)), lambda a, x: a + x), 9) AS score FROM (SELECT query_id, doc, 0 AS c, 1::double / (60 + rank) AS p FROM ra UNION ALL SELECT query_id, doc, 1, 0.5::double / (60 + rank) FROM rb) GROUP BY ALL)"
GRADED = f"""{BOOST}, {PLAIN}, {ranked('boosted', 5, 'ra')}, {ranked('plain', 5, 'rb')},
runs AS (SELECT *, 'boosted' AS profile FROM ra UNION ALL SELECT *, 'plain' FROM rb), ids AS (SELECT query_id, profile, list(doc ORDER BY rank) AS ids FROM runs GROUP BY ALL),
gold AS (SELECT query_id, list(doc ORDER BY doc) AS gold FROM ra WHERE rank <= 3 AND doc IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
g AS (SELECT query_id, profile, ids, coalesce(gold, []) AS gold FROM ids LEFT JOIN gold USING (query_id)),
graded AS (SELECT query_id, profile, len(list_intersect(ids, gold)) > 0 AS hit, CASE WHEN len(gold) > 0 THEN len(list_intersect(ids, gold)) / len(gold) END AS recall,
 coalesce(1.0::double / list_min(list_filter(list_transform(gold, lambda x: list_position(ids, x)), lambda p: p > 0)), 0) AS mrr, len(gold) > 0 AND len(list_intersect(ids, gold)) = len(gold) AS full_evidence,
 cast(query_id % 4 AS varchar) AS category, cast(query_id % 3 AS varchar) AS conversation FROM g)"""
MEANS = "count(*) AS n, round(avg(hit::double), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr"

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_repeat_boost, bm25_allowed_topk, bm25_code_scores, rrf_fusion, signal_ablation, hit_recall_mrr, grouping_report, paired_wins, percentiles, confusion, category_summary, expected_scores, cluster_bootstrap, token_statistics, stage_diagnosis, run_completeness)}
_W = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in metrics.WEIGHTS.items()) + " END"
SQL = {
    "token_statistics": f"SELECT doc_id AS doc, len({TERMS}) AS n_terms, len(list_distinct({TERMS})) AS n_distinct, len({TOKENS}) AS n_tokens, length(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS normalised_chars FROM documents",
    "stage_diagnosis": f"WITH {BOOST}, {PLAIN}, {ranked('boosted', 3, 'ra')}, {ranked('plain', 20, 'rb')} SELECT ra.query_id, ra.doc AS id, CASE WHEN rb.rank IS NULL THEN 'candidate_missing' WHEN rb.rank > 5 THEN 'ranking_loss' WHEN ra.rank = 1 AND rb.rank > 1 THEN 'ranking_position_loss' ELSE 'retrieved' END AS stage FROM ra LEFT JOIN rb ON ra.query_id = rb.query_id AND ra.doc = rb.doc",
    "run_completeness": "SELECT item_id AS question_id, 'boosted' AS profile FROM benchmark WHERE item_id % 2 = 1",
    "bm25_topk": f"WITH {PLAIN}, {ranked('plain', 10, 'r')} SELECT * FROM r",
    "bm25_repeat_boost": f"WITH {BOOST}, {ranked('boosted', 10, 'r')} SELECT * FROM r",
    "bm25_allowed_topk": f"WITH {BOOST}, able AS (SELECT * FROM boosted WHERE doc IN (SELECT doc_id FROM labels WHERE quality = 1)), {ranked('able', 10, 'r')} SELECT * FROM r",
    "bm25_code_scores": f"WITH {parts_sql('f', WORDS, 'float')}, t AS (SELECT query_id, doc, list_reduce(list_prepend(0::float, list(cast(part * qtf::float AS float) ORDER BY first)), lambda a, x: cast(a + x AS float)) AS score FROM f GROUP BY ALL) SELECT query_id, count(*) AS n, round(max(score::double), 3) AS best FROM t GROUP BY ALL",
    "rrf_fusion": f"WITH {FUSE}, {ranked('fu', 10, 'r')} SELECT * FROM r",
    "signal_ablation": f"""WITH {FUSE}, {ranked('fu', 10, 'r')},
 v AS (SELECT r.query_id, r.doc AS id, r.rank AS found, coalesce(ra.score, 0) AS lexical FROM r LEFT JOIN ra ON ra.query_id = r.query_id AND ra.doc = r.doc),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY found, id) AS c1, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, id) AS c2, row_number() OVER (PARTITION BY query_id ORDER BY id % 7 DESC, id) AS c3, row_number() OVER (PARTITION BY query_id ORDER BY id % 5 DESC, id) AS c4 FROM v),
 t AS (SELECT *, round(1::double / (60 + c1) + 1::double / (60 + c2) + 1::double / (60 + c3) + 4::double / (60 + c4), 9) AS full_score, round(1::double / (60 + c1) + 1::double / (60 + c3) + 4::double / (60 + c4), 9) AS less FROM k)
 SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY full_score DESC, id) AS full_rank, full_score, row_number() OVER (PARTITION BY query_id ORDER BY less DESC, id) AS ablated_rank FROM t""",
    "hit_recall_mrr": f"WITH {GRADED} SELECT query_id, profile, hit, round(recall, 6) AS recall, round(mrr, 6) AS mrr, full_evidence FROM graded",
    "grouping_report": f"WITH {GRADED} SELECT profile, category, conversation, {MEANS} FROM graded GROUP BY GROUPING SETS ((profile), (profile, category), (profile, conversation))",
    "paired_wins": f"WITH {GRADED}, m AS (SELECT query_id, profile, 'hit' AS metric, hit::double AS v FROM graded UNION ALL SELECT query_id, profile, 'mrr', mrr FROM graded) SELECT a.profile, a.metric, count(*) FILTER (a.v > b.v) AS wins, count(*) FILTER (a.v < b.v) AS losses, count(*) FILTER (a.v = b.v) AS ties FROM m a JOIN m b ON a.query_id = b.query_id AND a.metric = b.metric AND a.profile = 'boosted' AND b.profile = 'plain' GROUP BY ALL",
    "cluster_bootstrap": """WITH r AS (SELECT source AS cluster, cast(n_chars % 3 - 1 AS double) AS delta FROM documents), s AS (SELECT cluster, sum(delta) AS total, count(*) AS n FROM r GROUP BY ALL), c AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS k, count(*) OVER () AS clusters FROM s),
 d AS (SELECT i AS sample, cast('0x' || substr(md5('42/' || i || '/' || j), 1, 8) AS bigint) % (SELECT max(clusters) FROM c) AS k FROM range(10000) a(i), range((SELECT max(clusters) FROM c)) b(j)), m AS (SELECT sum(total) / sum(n) AS mean FROM d JOIN c USING (k) GROUP BY sample)
 SELECT round((SELECT avg(delta) FROM r), 6) AS mean, round(quantile_disc(mean, 0.025), 6) AS low, round(quantile_disc(mean, 0.975), 6) AS high FROM m""",
    "percentiles": "SELECT l_returnflag, median(l_extendedprice) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice) AS p95, count(l_extendedprice) AS n FROM lineitem GROUP BY ALL",
    "confusion": "WITH r AS (SELECT source, quality = 1 AS e, n_chars >= 1000 AS f FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, count(*) FILTER (e AND f) AS tp, count(*) FILTER (f AND NOT e) AS fp, count(*) FILTER (e AND NOT f) AS fn FROM r GROUP BY ALL) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c",
    "category_summary": f"WITH r AS (SELECT ({list(metrics.WEIGHTS)})[doc_id % 6 + 1] AS category, CASE WHEN n_chars > 800 THEN 1.0::double ELSE 0.25 END AS score FROM documents), e AS (SELECT category, count(*) AS n, count(*) FILTER (score > 0.999) AS passed, avg(score) AS average, sum(score) AS total FROM r GROUP BY ALL) SELECT category, n, passed, round(average, 6) AS average, NULL::double AS weighted FROM e UNION ALL SELECT NULL, sum(n)::bigint, sum(passed)::bigint, round(sum(total) / sum(n), 6), round(sum({_W}::double * average) / sum({_W}::double), 6) FROM e",
    "expected_scores": """WITH r AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS got FROM lineitem GROUP BY ALL), w AS (SELECT *, list_distinct(list_append(list_filter(got, lambda p: p % 3 = 0), l_orderkey % 50 + 1)) AS want FROM r), b AS (SELECT *, len(list_intersect(got, want)) AS both_ FROM w)
SELECT l_orderkey, round(CASE l_orderkey % 4 WHEN 0 THEN (got[1] = got[-1])::int::double WHEN 1 THEN list_contains(got[1:2], got[-1])::int::double WHEN 2 THEN both_::double / len(want) ELSE 2.0::double * both_ / (len(got) + len(want)) END, 6) AS score FROM b""",
}
