"""Chains of relational facts, and memories that later ones close."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import session
from factloom.functions import text as fx

from . import lexical

# The sentence templates in order; <s> and <o> are subject and object.
TEMPLATES = (
    "The author of <s> is <o>",
    "The chairperson of <s> is <o>",
    "The director of <s> is <o>",
    "The headquarters of <s> is located in the city of <o>",
    "The chief executive officer of <s> is <o>",
    "The univeristy where <s> was educated is <o>",
    "The capital of <s> is <o>",
    "The official language of <s> is <o>",
    "The type of music that <s> plays is <o>",
    "The company that produced <s> is <o>",
    "The name of the current head of (?:state in|the) <s> is <o>",
    "<s> was born in the city of <o>",
    "<s> died in the city of <o>",
    "<s> plays the position of <o>",
    "<s> is located in the continent of <o>",
    "<s> worked in the city of <o>",
    "<s> is married to <o>",
    "<s> was founded by <o>",
    "<s> was founded in the city of <o>",
    "<s> is associated with the sport of <o>",
    "<s> is a citizen of <o>",
    "<s> was performed by <o>",
    "<s> was created by <o>",
    "<s> was created in the country of <o>",
    "<s> speaks the language of <o>",
    "<s> is famous for <o>",
    "<s> is employed by <o>",
    "<s> is affiliated with the religion of <o>",
    "<s> works in the field of <o>",
    "<s>'s child is <o>",
    "<s> was written in the language of <o>",
)
HOPS, POOL, PINNED, DECAY = 3, 20, 3, 0.82


def one_pattern() -> tuple[str, str]:
    """All templates as one pattern, tried in order, and the replacement that puts the fitting one's ends around a mark."""
    pattern = "(?d)^(?:" + "|".join(re.sub("<[so]>", "(.+?)", t) + r"\.?$" for t in TEMPLATES) + ")"
    first, second = ([2 * i + 1 + k for i in range(len(TEMPLATES))] for k in (0, 1))
    swapped = [t.index("<s>") > t.index("<o>") for t in TEMPLATES]
    assert not any(swapped), "a template names its object first"
    return pattern, "".join(f"${i}" for i in first) + MARK + "".join(f"${i}" for i in second)


MARK = "\x01"


def endpoints(text: Column) -> Column:
    """(subject, object), normalised, of the first template that fits; null if none does."""
    pattern, ends = one_pattern()
    cut = F.split(F.regexp_replace(text, pattern, ends), MARK)
    pair = F.struct(fx.normalised(cut[0]).alias("s"), fx.normalised(cut[1]).alias("o"))
    return F.when(text.rlike(pattern) & ~F.contains(text, F.lit(MARK)), pair)


def fact_nodes(facts: DataFrame) -> DataFrame:
    """(doc, node): each fact with its subject and its object, one row if they are equal."""
    found = facts.select("doc", endpoints(F.col("text")).alias("e")).where("e IS NOT NULL")
    return found.select("doc", F.explode(F.array_distinct(F.array("e.s", "e.o"))).alias("node"))


def numbered_facts(texts: DataFrame) -> DataFrame:
    """(source, doc, text) of the lines `N. text` of texts (source, text)."""
    lines = texts.select("source", F.posexplode(F.split("text", "\n")).alias("doc", "line"))
    return lines.where(F.col("line").rlike(r"^\s*\d+\.\s*")).select("source", "doc", F.regexp_extract("line", r"^\s*\d+\.\s*(.*?)\s*$", 1).alias("text"))


def reached(seeds: DataFrame, nodes: DataFrame, hops: int = HOPS) -> DataFrame:
    """(query_id, doc, hop): documents within some hops over shared nodes of each seed, with the fewest hops.

    A frontier first becomes its distinct nodes, so that a hub is expanded once for each query and round.
    """
    seen = seeds.select("query_id", "doc", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        around = frontier.join(nodes, "doc").select("query_id", "node").distinct()
        step = around.join(nodes, "node").select("query_id", "doc").distinct()
        frontier = step.join(seen.select("query_id", "doc"), ["query_id", "doc"], "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        seen = seen.unionByName(frontier)
    return seen


def multi_hop(queries: DataFrame, facts: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, doc: the first three by words, then documents by words, hops from the best one and links.

    The nodes of the facts and the ranking by words are written once; all rounds read them.
    """
    tokens = fx.benchmark_tokens
    direct = lexical.filled(lexical.top(lexical.bm25_boosted(queries, facts, tokens), POOL), queries, facts, POOL).select("query_id", "doc", F.col("rank").alias("direct")).checkpoint()
    nodes = fact_nodes(facts).checkpoint()
    hops = reached(direct.where("direct = 1"), nodes)
    links = nodes.groupBy("node").agg((F.count("*") - 1).alias("others"))
    degree = nodes.join(links, "node").groupBy("doc").agg(F.sum("others").alias("degree"))
    both = direct.join(hops, ["query_id", "doc"], "full_outer").join(degree, "doc", "left")
    near = F.coalesce(F.pow(F.lit(DECAY), F.col("hop")) / (F.col("hop") + 1), F.lit(0.0))
    score = F.coalesce(0.2 / (60 + F.col("direct")), F.lit(0.0)) + near + F.least(F.coalesce("degree", F.lit(0)), F.lit(6)) * 0.01
    pinned = F.when(F.col("direct") <= PINNED, F.col("direct"))
    order = Window.partitionBy("query_id").orderBy(pinned.asc_nulls_last(), F.desc("score"), "doc")
    return both.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc")


def routed(queries: DataFrame, facts: DataFrame, k: int = 5) -> DataFrame:
    """query_id, profile (words, graph), routed, rank, doc: the first k by words, and along chains where the question asks along one.

    Questions that do not keep their ranking by words in both profiles. No function here accepts an expected answer.
    """
    gate = fx.nested_question(F.col("text"))
    plain = lexical.filled(lexical.top(lexical.bm25_boosted(queries, facts, fx.benchmark_tokens), k), queries, facts, k).select("query_id", "rank", "doc").checkpoint()
    chained = multi_hop(queries.where(gate), facts, k)
    graph = chained.unionByName(plain.join(queries.where(~gate).select("query_id"), "query_id", "left_semi"))
    asked = queries.select("query_id", gate.alias("routed"))
    return plain.withColumn("profile", F.lit("words")).unionByName(graph.withColumn("profile", F.lit("graph"))).join(asked, "query_id")


def answered(found: DataFrame, facts: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id and the other columns of found but rank and doc, hit: whether a found fact holds one of the expected answers (query_id, answers) as text. Evaluation only."""
    keys = [c for c in found.columns if c not in ("rank", "doc")]
    said = found.join(facts.select("doc", "text"), "doc").select(*keys, fx.normalised(F.col("text")).alias("said"))
    met = said.join(expected, "query_id").withColumn("hit", F.exists("answers", lambda a: (fx.normalised(a) != "") & F.contains(F.col("said"), fx.normalised(a))))
    return met.groupBy(*keys).agg(F.bool_or("hit").alias("hit"))


def routed_report(hits: DataFrame) -> DataFrame:
    """hits (query_id, source, profile, routed, hit): by source and over all, n, routed, hits of both profiles and wins, losses and ties of the graph."""
    both = hits.groupBy("source", "query_id").agg(F.bool_or("routed").alias("routed"), F.bool_or(F.when(F.col("profile") == "words", F.col("hit"))).alias("words"), F.bool_or(F.when(F.col("profile") == "graph", F.col("hit"))).alias("graph"))
    count = lambda c, name: F.count_if(c).alias(name)
    return both.groupingSets([[F.col("source")], []], F.col("source")).agg(
        F.count("*").alias("n"), count(F.col("routed"), "n_routed"), count(F.col("words"), "words_hits"), count(F.col("graph"), "graph_hits"),
        count(F.col("graph") & ~F.col("words"), "wins"), count(F.col("words") & ~F.col("graph"), "losses"), count(F.col("words") == F.col("graph"), "ties"),
    )


def linked_updates(points: DataFrame) -> DataFrame:
    """points (owner, pos, text, since, closes array<string>) with until, the time of the update that closed each.

    An update closes the latest still open earlier point with the same normalised text. That is how brackets match, so
    windows do it: with every point an opening and every update a closing one, a closing belongs to the last opening
    of its own level. One owner's points never have to be in one task unless they share a text.
    """
    opens = points.select("owner", fx.normalised(F.col("text")).alias("key"), F.col("pos"), F.lit(1).alias("order"), "since", F.lit(1).alias("step"))
    shuts = points.select("owner", F.posexplode("closes").alias("nth", "old"), "pos", "since").select("owner", fx.normalised(F.col("old")).alias("key"), "pos", F.lit(0).alias("order"), "since", F.lit(-1).alias("step"))
    w = Window.partitionBy("owner", "key").orderBy("pos", "order").rowsBetween(Window.unboundedPreceding, 0)
    both = opens.unionByName(shuts).withColumn("sum", F.sum("step").over(w))
    both = both.withColumn("low", F.least(F.lit(0), F.min("sum").over(w)))
    depth = F.col("sum") - F.col("low")
    before = F.lag(depth, 1, 0).over(Window.partitionBy("owner", "key").orderBy("pos", "order"))
    level = both.withColumn("depth", depth).withColumn("before", before).where("step = 1 OR before > 0").withColumn("level", F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("before")))
    ahead = Window.partitionBy("owner", "key", "level").orderBy("pos", "order")
    paired = level.withColumn("next_step", F.lead("step").over(ahead)).withColumn("next_since", F.lead("since").over(ahead)).where("step = 1")
    until = paired.select("owner", "pos", F.when(F.col("next_step") == -1, F.col("next_since")).alias("until"))
    return points.join(until, ["owner", "pos"], "left")


def active(at: Column, since: Column, until: Column) -> Column:
    return (since <= at) & (until.isNull() | (at < until))


def snapshot_links(points: DataFrame) -> DataFrame:
    """points (owner, session, pos, text, since, closes) with until and until_session, when and in which session an update closed each."""
    linked = linked_updates(points.withColumn("since", F.struct("since", "session")))
    return linked.withColumn("until_session", F.col("until.session")).withColumn("until", F.col("until.since")).withColumn("since", F.col("since.since"))


def as_of(counts: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """wanted (key..., session) with the sums of counts (key..., session, numbers...) over the sessions so far, its own included.

    Counts and wanted rows are one ordered run for each key, so that no count is copied into later sessions.
    """
    numbers = [c for c in counts.columns if c not in (*key, "session")]
    blank = wanted.select(*key, "session", *[F.lit(0).cast("long").alias(c) for c in numbers], F.lit(True).alias("__asks")).distinct()
    w = Window.partitionBy(*key).orderBy("session").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = counts.withColumn("__asks", F.lit(False)).unionByName(blank)
    return both.select(*key, "session", "__asks", *[F.sum(c).over(w).alias(c) for c in numbers]).where("__asks").drop("__asks")


def snapshot_hits(points: DataFrame, asked: DataFrame, sizes: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, owner, held, doc, since, until, score of each point of a question's snapshot that shares a word with it.

    Document frequencies and lengths are running sums by (owner, term) and owner, read as of the asked session; a
    question then meets the postings of its own terms and owner only. until: as it was known in that session.
    """
    group = ["owner", "session"]
    terms = session.written(lexical.query_terms(asked, fx.benchmark_tokens, group), "terms")
    df = as_of(postings.groupBy("owner", "term", "session").agg(F.count("*").alias("df")), terms, ["owner", "term"]).where("df > 0")
    mean = F.coalesce(F.nullif(F.col("tokens") / F.nullif(F.col("held"), F.lit(0)), F.lit(0.0)), F.lit(1.0)).alias("mean")
    weights = lexical.weighted(terms, df, sizes.select(*group, F.col("held").alias("total"), mean), group).withColumnRenamed("session", "asked")
    met = session.written(weights, "weights").join(postings, ["owner", "term"]).where(F.col("session") <= F.col("asked"))
    parts = met.select("query_id", "owner", "asked", "session", "doc", "qtf", "first", lexical.added().alias("part"))
    scores = parts.groupBy("query_id", "owner", "asked", "session", "doc").agg(lexical.boosted_score().alias("score")).where("score > 0")
    when = F.when(F.col("until_session") <= F.col("asked"), F.col("until")).alias("until")
    return scores.join(points.withColumnRenamed("pos", "doc"), [*group, "doc"]).select("query_id", "doc", "since", when, "score")


#: Points in the first slice that fills a ranking; each further slice is twice as large.
FIRST_SLICE = 16


def memory_search(points: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """question_id, arm (flat, temporal), rank, point, stale: the k best points of each question's snapshot, and of its active ones.

    points: from snapshot_links(), pos growing with session. questions: (question_id, owner, session, text, at).
    A snapshot is the owner's points of the sessions so far; an update of a later session is not seen, and statistics
    are those of the snapshot. Points without a common word fill up in their order: only questions that lack some meet
    further points, in slices of their owner's points that double in size, until they have k or their snapshot ends.
    stale: the point is not active at the question's time.
    """
    group = ["owner", "session"]
    asked = questions.select(F.col("question_id").alias("query_id"), *group, "text", "at")
    postings = lexical.indexed(points.select(*group, F.col("pos").alias("doc"), "text"), fx.benchmark_tokens, group).postings
    of_session = points.groupBy(*group).agg(F.count("*").alias("held")).join(postings.groupBy(*group).agg(F.sum("tf").alias("tokens")), group, "left").fillna(0, ["tokens"])
    of_session = session.written(of_session, "sessions")
    sizes = session.written(as_of(of_session, asked, ["owner"]), "sizes")
    hits = snapshot_hits(points, asked, sizes, postings).join(asked.select("query_id", "at"), "query_id").withColumn("stale", ~active(F.col("at"), F.col("since"), F.col("until")))
    arms = F.when(F.col("stale"), fx.strings(["flat"])).otherwise(fx.strings(["flat", "temporal"]))
    by_arm = Window.partitionBy("query_id", "arm")
    placed = hits.select("query_id", F.explode(arms).alias("arm"), "doc", "stale", "score").withColumn("rank", F.row_number().over(by_arm.orderBy(F.desc("score"), "doc")))
    best = session.written(placed.where(F.col("rank") <= k).drop("rank"), "hits")

    before = of_session.select(*group, (F.sum("held").over(Window.partitionBy("owner").orderBy("session")) - F.col("held")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy(*group).orderBy("pos")) - 1
    numbered = session.written(points.join(before, group).select("owner", F.col("pos").alias("doc"), "since", "until", "until_session", place.alias("place")), "places")
    have = best.groupBy("query_id", "arm").agg(F.count("*").alias("n"))
    lacking = asked.join(sizes, group).select("query_id", "owner", F.col("session").alias("asked"), "at", "held", F.explode(fx.strings(["flat", "temporal"])).alias("arm"))
    lacking = lacking.join(have, ["query_id", "arm"], "left").withColumn("missing", F.lit(k) - F.coalesce("n", F.lit(0))).drop("n").where("missing > 0 AND held > 0")
    parts, start, size = [best], 0, FIRST_SLICE
    while True:
        lacking = session.written(lacking, "lacking")
        if lacking.isEmpty():
            break
        slice_ = numbered.where((F.col("place") >= start) & (F.col("place") < start + size))
        seen = F.when(F.col("until_session") <= F.col("asked"), F.col("until"))
        near = lacking.join(slice_, "owner").where(F.col("place") < F.col("held")).withColumn("stale", ~active(F.col("at"), F.col("since"), seen)).where("arm = 'flat' OR NOT stale")
        spare = near.join(best, ["query_id", "arm", "doc"], "left_anti").withColumn("nth", F.row_number().over(by_arm.orderBy("doc"))).where("nth <= missing")
        parts.append(session.written(spare.select("query_id", "arm", "doc", "stale", F.lit(0.0).alias("score")), "spare"))
        got = parts[-1].groupBy("query_id", "arm").agg(F.count("*").alias("n"))
        start, size = start + size, 2 * size
        lacking = lacking.join(got, ["query_id", "arm"], "left").withColumn("missing", F.col("missing") - F.coalesce("n", F.lit(0))).drop("n").where((F.col("missing") > 0) & (F.col("held") > start))
    both = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(by_arm.orderBy(F.desc("score"), "doc")))
    return both.select(F.col("query_id").alias("question_id"), "arm", "rank", F.col("doc").alias("point"), "stale")


def memory_metrics(found: DataFrame, points: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id, arm, hit, recall, stale: found points held against evidence (question_id, evidence array<string>), by normalised text. Evaluation only."""
    said = found.join(points.select(F.col("pos").alias("point"), fx.normalised(F.col("text")).alias("said")), "point").groupBy("question_id", "arm").agg(F.collect_set("said").alias("said"), F.count_if("stale").alias("stale"))
    want = evidence.select("question_id", F.array_distinct(F.transform("evidence", fx.normalised)).alias("want"))
    arms = want.withColumn("arm", F.explode(fx.strings(["flat", "temporal"])))
    rows = arms.join(said, ["question_id", "arm"], "left").withColumn("both", F.coalesce(F.size(F.array_intersect("said", "want")), F.lit(0)))
    return rows.select("question_id", "arm", F.size("want").alias("evidence_count"), (F.col("both") > 0).alias("hit"), F.coalesce(F.col("both") / F.nullif(F.size("want"), F.lit(0)), F.lit(0.0)).alias("recall"), F.coalesce("stale", F.lit(0)).alias("stale"))


def memory_report(rows: DataFrame, types: DataFrame) -> DataFrame:
    """By question type and over all, of questions with evidence: n, rates of both arms, wins, losses and stale slots. types: (question_id, type)."""
    arm = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c)))
    names = [(a, c) for c in ("hit", "recall", "stale") for a in ("flat", "temporal")]
    one = rows.where("evidence_count > 0").groupBy("question_id").agg(*[arm(a, c).alias(f"{a}_{c}") for a, c in names]).join(types, "question_id")
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}5")
    return one.groupingSets([[F.col("type")], []], F.col("type")).agg(
        F.count("*").alias("n"), rate("flat_hit"), rate("temporal_hit"), rate("flat_recall"), rate("temporal_recall"),
        F.count_if(F.col("temporal_hit") & ~F.col("flat_hit")).alias("wins"), F.count_if(F.col("flat_hit") & ~F.col("temporal_hit")).alias("losses"),
        F.sum("flat_stale").cast("long").alias("flat_stale_slots"), F.sum("temporal_stale").cast("long").alias("temporal_stale_slots"),
    )
