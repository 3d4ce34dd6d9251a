"""Evaluation of frozen retrieval runs: labels are joined only after rankings are fixed.

runs: (question_id, profile, ids array<string>, answer date). labels: (question_id, conversation_id, question, category,
evidence array<string>, answer string). Category 5 is adversarial: its evidence is a lure, not a proof.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as fx

from . import metrics

ADVERSARIAL = 5
# The metrics of a run.
METRICS = ("hit", "recall", "mrr", "full_evidence")


def question_key(sample: Column, index: Column) -> Column:
    return F.format_string("%s/qa/%03d", sample, index)


def gold(evidence: Column) -> Column:
    """The distinct dialogue ids of raw evidence entries, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(evidence, fx.dialogue_ids))))


def frozen(questions: DataFrame, profiles: list[str], search: Callable[[DataFrame, str], DataFrame], repeats: int = 1) -> DataFrame:
    """Every question under every profile: question_id, profile, ids. search gets nothing but the questions and a profile.

    The profiles' order is rotated for each question, as turn tells. Repeated searches must agree; a run in which they
    do not fails when it is read.
    """
    parts = []
    for place, profile in enumerate(profiles):
        runs = [search(questions, profile).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dia_id"))), lambda x: x["dia_id"]).alias("ids")) for _ in range(max(1, repeats))]
        asked = questions.select("question_id")
        one = asked.join(runs[0], "question_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
        for again in runs[1:]:
            one = one.join(again.withColumnRenamed("ids", "again"), "question_id", "left")
            one = one.withColumn("ids", F.when(F.col("ids") == F.coalesce("again", F.array().cast("array<string>")), F.col("ids")).otherwise(F.raise_error(F.lit("a search gave two results")))).drop("again")
        turn = F.pmod(F.lit(place) - F.pmod(F.xxhash64("question_id"), F.lit(len(profiles))), F.lit(len(profiles))).cast("int")
        parts.append(one.select("question_id", F.lit(profile).alias("profile"), "ids", turn.alias("turn")))
    return reduce(DataFrame.unionByName, parts)


def checked(runs: DataFrame, questions: DataFrame, known: DataFrame, profiles: list[str]) -> DataFrame:
    """What speaks against a frozen run: question_id, profile, flaw. Empty when all is well.

    known: (question_id, known array<string>), the ids that the question's conversation has.
    """
    again = runs.groupBy("question_id", "profile").agg(F.count("*").alias("n")).where("n > 1").select("question_id", "profile", F.lit("twice").alias("flaw"))
    met = runs.join(questions.select("question_id", F.lit(True).alias("asked")), "question_id", "left").join(known, "question_id", "left")
    flaw = (
        F.when(F.col("asked").isNull(), "unknown question").when(~F.col("profile").isin(*profiles), "unknown profile").when(F.size("ids") > 5, "more than five")
        .when(F.size(F.array_distinct("ids")) < F.size("ids"), "an id twice").when(F.size(F.array_except("ids", F.coalesce("known", F.array().cast("array<string>")))) > 0, "unknown id")
    )
    missing = metrics.missing_runs(runs, questions, profiles).select("question_id", "profile", F.lit("missing").alias("flaw"))
    return again.unionByName(met.select("question_id", "profile", flaw.alias("flaw")).where("flaw IS NOT NULL")).unionByName(missing)


def scored(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """runs with their labels, the metrics of METRICS (null for adversarial questions and without evidence), lure (adversarial ones with evidence only), gold_date (of `when` questions) and date_correct."""
    rows = runs.join(labels, "question_id").withColumn("gold", gold(F.col("evidence")))
    rows = metrics.retrieval_metrics(rows)
    counts = (F.col("category") != ADVERSARIAL) & (F.size("gold") > 0)
    for m in METRICS:
        rows = rows.withColumn(m, F.when(counts, F.col(m).cast("double")))
    lure = F.when((F.col("category") == ADVERSARIAL) & (F.size("gold") > 0), F.size(F.array_intersect("ids", "gold")) > 0)
    day = F.when(F.col("question").rlike(r"(?i)^when\b"), fx.gold_date(F.col("answer_text")))
    return rows.withColumn("lure", lure).withColumn("gold_date", day).withColumn("date_correct", F.when(F.col("gold_date").isNotNull(), F.coalesce(F.col("answer") == F.col("gold_date"), F.lit(False))))


def means(*more: Column) -> list[Column]:
    return [F.count("hit").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS], *more]


def report(rows: DataFrame) -> DataFrame:
    """By profile, by profile and category, and by profile and conversation: means of evidence, lures and calendar answers; null where nothing counts.

    lure_rate is of adversarial questions with evidence. Of questions with a gold date: n_dates, answered, correct,
    coverage, accuracy, and precision among those that were answered.
    """
    lure, dated = F.col("lure").cast("double"), F.col("gold_date").isNotNull()
    said = dated & F.col("answer").isNotNull()
    right = F.when(dated, F.col("date_correct").cast("double"))
    sets = [[F.col("profile")], [F.col("profile"), F.col("category")], [F.col("profile"), F.col("conversation_id")]]
    return rows.groupingSets(sets, F.col("profile"), F.col("category"), F.col("conversation_id")).agg(
        *means(
            F.count("lure").alias("n_lures"), F.round(F.avg(lure), 6).alias("lure_rate"), F.count_if((F.col("category") == ADVERSARIAL) & F.col("answer").isNotNull()).alias("adversarial_answers"),
            F.count_if(dated).alias("n_dates"), F.count_if(said).alias("answered"), F.coalesce(F.sum(right), F.lit(0.0)).cast("long").alias("correct"), F.round(F.avg(F.when(dated, said.cast("double"))), 6).alias("coverage"),
            F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(F.when(said, right)), 6).alias("precision"),
        )
    )


def audited(labels: DataFrame, known: DataFrame) -> DataFrame:
    """Questions whose gold is empty, has ids that the conversation lacks, or that normalising changed: question_id, is_empty, missing, changed."""
    raw = F.array_sort(F.array_distinct(F.flatten(F.transform("evidence", lambda e: F.regexp_extract_all(e, F.lit(r"D\d+:\d+"), 0)))))
    rows = labels.join(known, "question_id").withColumn("gold", gold(F.col("evidence"))).withColumn("raw", raw)
    out = rows.select("question_id", (F.size("gold") == 0).alias("is_empty"), F.array_except("gold", "known").alias("missing"), (F.col("raw") != F.col("gold")).alias("changed"))
    return out.where("is_empty OR size(missing) > 0 OR changed")


def outcomes(rows: DataFrame, references: list[str]) -> DataFrame:
    """question_id, profile, reference, metric, outcome (win, loss, tie) of each other profile against each reference: the ids behind a paired matrix."""
    pair = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    flat = rows.select("question_id", "profile", "category", pair.alias("m")).select("question_id", "profile", "category", "m.*").where("value IS NOT NULL")
    base = flat.where(F.col("profile").isin(*references)).select("question_id", "metric", F.col("profile").alias("reference"), F.col("value").alias("base"))
    met = flat.join(base, ["question_id", "metric"]).where("profile <> reference")
    return met.select("question_id", "profile", "reference", "category", "metric", F.when(F.col("value") > F.col("base"), "win").when(F.col("value") < F.col("base"), "loss").otherwise("tie").alias("outcome"))


def paired_matrix(results: DataFrame) -> DataFrame:
    """outcomes() counted: profile, reference, metric, wins, losses, ties."""
    n = lambda o, name: F.count_if(F.col("outcome") == o).alias(name)
    return results.groupBy("profile", "reference", "metric").agg(n("win", "wins"), n("loss", "losses"), n("tie", "ties"))


def win_examples(results: DataFrame, metric: str, k: int = 3) -> DataFrame:
    """The first k wins of each profile, reference and category."""
    w = Window.partitionBy("profile", "reference", "category").orderBy("question_id")
    return results.where((F.col("metric") == metric) & (F.col("outcome") == "win")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("profile", "reference", "category", "nth", "question_id")


def misses(rows: DataFrame, turns: DataFrame, terms: Callable[[Column], Column], reach: int = 2) -> DataFrame:
    """Why questions with evidence found none of it: question_id, profile, missing_id, near, no_common_term.

    missing_id: gold that no turn has. near: a found turn lies within some turns of gold in the same session.
    no_common_term: no gold turn shares a term with the question.
    """
    lost = rows.where("hit = 0").select("question_id", "profile", "conversation_id", "question", "ids", "gold")
    place = turns.select("conversation_id", "dia_id", "session", "pos", "text")
    golds = lost.select("question_id", "profile", "conversation_id", "question", F.explode("gold").alias("dia_id")).join(place, ["conversation_id", "dia_id"], "left")
    found = lost.select("question_id", "profile", "conversation_id", F.explode("ids").alias("dia_id")).join(place.drop("text"), ["conversation_id", "dia_id"]).select("question_id", "profile", "session", F.col("pos").alias("found_pos"))
    near = golds.join(found, ["question_id", "profile", "session"]).where(F.abs(F.col("pos") - F.col("found_pos")) <= reach).select("question_id", "profile").distinct().withColumn("near", F.lit(True))
    common = F.size(F.array_intersect(terms(F.col("question")), terms(F.col("text")))) > 0
    each = golds.groupBy("question_id", "profile").agg(F.bool_or(F.col("pos").isNull()).alias("missing_id"), (~F.coalesce(F.bool_or(common), F.lit(False))).alias("no_common_term"))
    return each.join(near, ["question_id", "profile"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def binary_summary(rows: DataFrame, field: str, by: list[str]) -> DataFrame:
    """n, hits and rate of a boolean."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(field).alias("hits"), F.round(F.avg(F.col(field).cast("double")), 6).alias("rate"))


def ranking_digest(runs: DataFrame) -> DataFrame:
    """(profile, rows, digest) of all rankings without timings, whatever their order: rows are digested one by one and added up.

    The sum of 52-bit parts of the rows' digests does not depend on order or partitioning; nothing is put together.
    """
    one = F.conv(F.left(F.sha2(F.concat_ws("|", "question_id", "profile", F.array_join("ids", ",")), 256), F.lit(13)), 16, 10).cast("decimal(38,0)")
    return runs.groupBy("profile").agg(F.count("*").alias("rows"), F.sum(one).cast("string").alias("digest"))


def control(frozen_rows: DataFrame, rerun: DataFrame) -> DataFrame:
    """Questions that one side lacks or whose rankings differ: question_id, profile, flaw."""
    both = frozen_rows.select("question_id", "profile", F.col("ids").alias("was")).join(rerun.select("question_id", "profile", F.col("ids").alias("now")), ["question_id", "profile"], "full_outer")
    flaw = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "different")
    return both.select("question_id", "profile", flaw.alias("flaw")).where("flaw IS NOT NULL")


def manifest(tables: dict[str, DataFrame], parameters: dict[str, str]) -> DataFrame:
    """One row about a run, to be written before scoring: parameters, and of each table its rows and a digest that does not depend on their order."""
    parts = []
    for name, rows in sorted(tables.items()):
        text = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
        one = F.conv(F.left(F.sha2(text, 256), F.lit(13)), 16, 10).cast("decimal(38,0)")
        parts.append(rows.select(one.alias("one")).agg(F.count("*").alias("rows"), F.sum("one").cast("string").alias("digest")).select(F.struct(F.lit(name).alias("name"), "rows", "digest").alias("t")))
    held = reduce(DataFrame.unionByName, parts).agg(F.array_sort(F.collect_list("t")).alias("tables"))
    return held.withColumn("parameters", F.create_map(*[F.lit(x) for kv in sorted(parameters.items()) for x in kv]) if parameters else F.create_map().cast("map<string,string>"))


def task_report(replay: DataFrame, expected: DataFrame, record: DataFrame | None = None) -> DataFrame:
    """A code-task run scored after its rankings are frozen: category, n, passed, average, weighted, and agree, the rankings equal to a record.

    replay: (query_id, id, rank). expected: (query_id, category, kind, target, k, wanted). record: (query_id, ids).
    """
    ids = replay.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    rows = expected.join(ids, "query_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    score = metrics.expected_score(F.col("kind"), F.col("ids"), F.col("target"), F.col("k"), F.col("wanted"))
    out = metrics.category_summary(rows.select("category", score.alias("score")))
    if record is None:
        return out
    same = rows.join(record.select("query_id", F.col("ids").alias("recorded")), "query_id").agg(F.count_if(F.col("ids") == F.col("recorded")).alias("agree"))
    return out.crossJoin(F.broadcast(same))
