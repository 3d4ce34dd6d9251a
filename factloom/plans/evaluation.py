"""Queries over frozen runs of the dialogue searches and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import session
from factloom.functions import text as fx
from factloom.operators import dates, dialogue, evaluation
from factloom.sources import tables

from . import dialogue as talk
from .search import TERMS

PROFILES = ["bm25", "guarded"]


def run(spark, sf_dir):
    """(rows, labels, turns): frozen runs of both profiles with their calendar answers, and what they are scored against."""
    eps, q = talk.inputs(spark, sf_dir)
    rankings = dialogue.searched_alike(q, eps, PROFILES)
    runs = evaluation.frozen(q, PROFILES, lambda _, profile: rankings[profile]).drop("turn")
    # whole turns are read for answers only, which are of the first places of `when` questions
    when = q.where(F.col("question").rlike(dialogue.WHEN))
    answers = [dialogue.date_answers(q, dialogue.with_turns(rankings[p].where("rank = 1"), when, eps)).select("question_id", F.lit(p).alias("profile"), "answer") for p in PROFILES]
    rows = session.written(runs.join(answers[0].unionByName(answers[1]), ["question_id", "profile"]), "runs")
    return rows, session.written(tables.question_labels(spark, sf_dir), "labels"), eps


def known_ids(labels, eps):
    ids = eps.groupBy("conversation_id").agg(F.collect_set("dia_id").alias("known"))
    return labels.select("question_id", "conversation_id").join(ids, "conversation_id").drop("conversation_id")


def evaluation_report(spark, sf_dir):
    rows, labels, _ = run(spark, sf_dir)
    return evaluation.report(evaluation.scored(rows, labels))


def evaluation_rows(spark, sf_dir):
    """Every question under every profile with its metrics."""
    rows, labels, _ = run(spark, sf_dir)
    r = lambda c: F.round(c, 6).alias(c)
    return evaluation.scored(rows, labels).select("question_id", "profile", "hit", r("recall"), r("mrr"), "full_evidence", "lure", "gold_date", "date_correct")


def evaluation_pairs(spark, sf_dir):
    """Wins, losses and ties of all metrics against both profiles."""
    rows, labels, _ = run(spark, sf_dir)
    return evaluation.paired_matrix(evaluation.outcomes(evaluation.scored(rows, labels), PROFILES))


def evaluation_wins(spark, sf_dir):
    rows, labels, _ = run(spark, sf_dir)
    return evaluation.win_examples(evaluation.outcomes(evaluation.scored(rows, labels), ["bm25"]), "mrr")


def evaluation_misses(spark, sf_dir):
    rows, labels, eps = run(spark, sf_dir)
    return evaluation.misses(evaluation.scored(rows, labels), eps, fx.conversation_terms)


def evaluation_audit(spark, sf_dir):
    labels = tables.question_labels(spark, sf_dir)
    return evaluation.audited(labels, known_ids(labels, tables.turns(spark, sf_dir))).select("question_id", "is_empty", F.array_join("missing", ",").alias("missing"), "changed")


def evaluation_dated(spark, sf_dir):
    """Hits of questions in which the calendar rules find a date or period, by profile."""
    rows, labels, _ = run(spark, sf_dir)
    dated = evaluation.scored(rows, labels).where(F.col("hit").isNotNull() & (F.size(dates.explicit_times(F.col("question"))) > 0))
    return evaluation.binary_summary(dated.withColumn("found", F.col("hit") == 1), "found", ["profile"])


def evaluation_checks(spark, sf_dir):
    """What speaks against runs that lack the guarded profile of one question in three and hold one in five of the others twice."""
    rows, labels, eps = run(spark, sf_dir)
    odd = F.pmod(F.crc32("question_id"), F.lit(15))
    kept = rows.where((F.col("profile") != "guarded") | (odd % 3 != 0))
    runs = kept.unionByName(kept.where((odd % 5 == 0) & (F.col("profile") == "bm25")))
    return evaluation.checked(runs, labels.select("question_id"), known_ids(labels, eps), PROFILES)


def ranking_digests(spark, sf_dir):
    rows, _, _ = run(spark, sf_dir)
    return evaluation.ranking_digest(rows)


QUERIES = {f.__name__: f for f in (evaluation_report, evaluation_rows, evaluation_pairs, evaluation_wins, evaluation_misses, evaluation_audit, evaluation_dated, evaluation_checks, ranking_digests)}

RUN_SQL = f"""WITH {talk.asked_sql()}, {tables.LABELS_SQL}, {talk.search_ctes('bm25', 'b')}, {talk.reader_ctes('b')}, {talk.search_ctes('guarded', 'g')}, {talk.reader_ctes('g')},
run AS (SELECT question_id, 'bm25' AS profile, (SELECT coalesce(list(dia_id ORDER BY rank), []) FROM b_top t WHERE t.question_id = q2.question_id) AS ids, (SELECT any_value(answer) FROM b_read r WHERE r.question_id = q2.question_id) AS answer FROM q2
 UNION ALL SELECT question_id, 'guarded', (SELECT coalesce(list(dia_id ORDER BY rank), []) FROM g_top t WHERE t.question_id = q2.question_id), (SELECT any_value(answer) FROM g_read r WHERE r.question_id = q2.question_id) FROM q2),
joined AS (SELECT run.*, q2.conversation_id, q2.question, category, gold, len(list_intersect(ids, gold)) AS found, category <> 5 AND len(gold) > 0 AS counts, CASE WHEN question LIKE 'When %' THEN said_day END AS gold_date FROM run JOIN q2 USING (question_id) JOIN labels USING (question_id)),
rows_ AS (SELECT *, CASE WHEN counts THEN (found > 0)::int::double END AS hit, CASE WHEN counts THEN found::double / len(gold) END AS recall,
 CASE WHEN counts THEN coalesce(1.0::double / list_min(list_filter(list_transform(gold, lambda x: list_position(ids, x)), lambda p: p > 0)), 0) END AS mrr, CASE WHEN counts THEN (found = len(gold))::int::double END AS full_evidence,
 CASE WHEN category = 5 AND len(gold) > 0 THEN found > 0 END AS lure, CASE WHEN gold_date IS NOT NULL THEN coalesce(answer = gold_date, false) END AS date_correct FROM joined),
oc AS (SELECT a.question_id, a.profile, b.profile AS reference, a.category, a.metric, CASE WHEN a.v > b.v THEN 'win' WHEN a.v < b.v THEN 'loss' ELSE 'tie' END AS outcome
 FROM (UNPIVOT (SELECT question_id, profile, category, hit, recall, mrr, full_evidence FROM rows_) ON hit, recall, mrr, full_evidence INTO NAME metric VALUE v) a
 JOIN (UNPIVOT (SELECT question_id, profile, category, hit, recall, mrr, full_evidence FROM rows_) ON hit, recall, mrr, full_evidence INTO NAME metric VALUE v) b ON a.question_id = b.question_id AND a.metric = b.metric AND a.profile <> b.profile)"""
SQL = {
    "evaluation_rows": f"{RUN_SQL} SELECT question_id, profile, hit, round(recall, 6) AS recall, round(mrr, 6) AS mrr, full_evidence, lure, gold_date, date_correct FROM rows_",
    "evaluation_report": f"""{RUN_SQL} SELECT profile, category, conversation_id, count(hit) AS n, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(full_evidence), 6) AS full_evidence, count(lure) AS n_lures, round(avg(lure::int::double), 6) AS lure_rate,
 count(*) FILTER (category = 5 AND answer IS NOT NULL) AS adversarial_answers, count(gold_date) AS n_dates, count(*) FILTER (gold_date IS NOT NULL AND answer IS NOT NULL) AS answered, count(*) FILTER (date_correct) AS correct,
 round(avg((answer IS NOT NULL)::int::double) FILTER (gold_date IS NOT NULL), 6) AS coverage, round(avg(date_correct::int::double), 6) AS accuracy, round(avg(date_correct::int::double) FILTER (answer IS NOT NULL), 6) AS precision FROM rows_ GROUP BY GROUPING SETS ((profile), (profile, category), (profile, conversation_id))""",
    "evaluation_pairs": f"{RUN_SQL} SELECT profile, reference, metric, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'tie') AS ties FROM oc GROUP BY ALL",
    "evaluation_wins": f"{RUN_SQL} SELECT profile, reference, category, cast(row_number() OVER (PARTITION BY profile, reference, category ORDER BY question_id) AS integer) AS nth, question_id FROM oc WHERE metric = 'mrr' AND outcome = 'win' AND reference = 'bm25' QUALIFY nth <= 3",
    "evaluation_misses": f"""{RUN_SQL}, lo AS (SELECT question_id, profile, conversation_id, ids, gold FROM rows_ WHERE hit = 0), gd AS (SELECT lo.question_id, profile, lo.conversation_id, x.dia_id, session, pos, text FROM lo, unnest(gold) x(dia_id) LEFT JOIN turns t ON t.conversation_id = lo.conversation_id AND t.dia_id = x.dia_id),
 fd AS (SELECT question_id, profile, session, pos FROM lo, unnest(ids) x(dia_id) JOIN turns t ON t.conversation_id = lo.conversation_id AND t.dia_id = x.dia_id), gt AS (SELECT question_id, profile, {TERMS} AS toks FROM gd WHERE text IS NOT NULL), cm AS (SELECT DISTINCT gt.question_id, profile FROM gt JOIN qt ON qt.question_id = gt.question_id AND list_contains(toks, term)),
 nr AS (SELECT DISTINCT gd.question_id, gd.profile FROM gd JOIN fd ON fd.question_id = gd.question_id AND fd.profile = gd.profile AND fd.session = gd.session AND abs(fd.pos - gd.pos) <= 2)
 SELECT gd.question_id, gd.profile, bool_or(pos IS NULL) AS missing_id, (gd.question_id, gd.profile) NOT IN (SELECT (question_id, profile) FROM cm) AS no_common_term, (gd.question_id, gd.profile) IN (SELECT (question_id, profile) FROM nr) AS near FROM gd GROUP BY ALL""",
    "ranking_digests": f"{RUN_SQL} SELECT profile, count(*) AS rows, cast(sum(cast('0x' || left(sha256(concat_ws('|', question_id, profile, array_to_string(ids, ','))), 13) AS hugeint)) AS varchar) AS digest FROM run GROUP BY ALL",
    "evaluation_audit": f"""WITH {tables.TURNS_SQL}, {tables.LABELS_SQL}, kn AS (SELECT conversation_id, list(dia_id) AS known FROM turns GROUP BY ALL), a AS (SELECT question_id, len(gold) = 0 AS is_empty, list_filter(gold, lambda x: NOT list_contains(known, x)) AS missing, padded AS changed FROM labels JOIN kn ON kn.conversation_id = cast(split_part(question_id, '/', 1) AS bigint))
 SELECT question_id, is_empty, array_to_string(missing, ',') AS missing, changed FROM a WHERE is_empty OR len(missing) > 0 OR changed""",
    "evaluation_dated": f"{RUN_SQL} SELECT profile, count(*) AS n, count(*) FILTER (hit = 1) AS hits, round(avg((hit = 1)::int::double), 6) AS rate FROM rows_ WHERE hit IS NOT NULL AND qf_of(question) GROUP BY ALL".replace("qf_of(question)", "question LIKE 'In %'"),
}
