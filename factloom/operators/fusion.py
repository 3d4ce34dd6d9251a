"""Reciprocal-rank fusion of channels, explanation of its signals, and replay without some of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import session

CHANNELS = ("structural_order", "bm25", "edge_frequency", "graph_degree", "id_overlap")
# Constant and channel weights of each structural operation.
POLICY = {
    "file_symbols": (10, (1, 4, 0, 8, 0)),
    "contained_by": (60, (1, 0, 0, 0, 0)),
    "implementors": (60, (1, 4, 0, 4, 8)),
    "callers": (60, (1, 1, 1, 4, 0)),
    "callees": (10, (1, 0.25, 8, 0, 0)),
    "orphans": (60, (1, 0, 0, 0, 0)),
}
DEFAULT = (60, (1, 0, 0, 0, 0))
PLACES = 9


def signal_parts(ranks: dict[str, Column], weights: dict[str, float], constant: float) -> Column:
    """array<struct<channel, rank, weight, contribution>>, channels in order; a missing rank adds nothing."""
    one = lambda c: F.struct(F.lit(c).alias("channel"), ranks[c].cast("int").alias("rank"), F.lit(float(weights[c])).alias("weight"), F.coalesce(F.lit(float(weights[c])) / (F.lit(float(constant)) + ranks[c]), F.lit(0.0)).alias("contribution"))
    return F.array(*[one(c) for c in ranks])


def total(parts: Column, disabled: tuple[str, ...] = ()) -> Column:
    kept = F.filter(parts, lambda s: ~s["channel"].isin(*disabled)) if disabled else parts
    return F.round(F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["contribution"]), PLACES)


def fused(rankings: list[DataFrame], weights: list[float], constant: float) -> DataFrame:
    """query_id, doc, score of weighted reciprocal ranks. rankings: (query_id, doc, rank) each; weight 0 leaves a channel out."""
    parts = [r.select("query_id", "doc", F.lit(i).alias("channel"), (F.lit(float(w)) / (constant + F.col("rank"))).alias("part")) for i, (r, w) in enumerate(zip(rankings, weights, strict=True)) if w]
    both = reduce(DataFrame.unionByName, parts)
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("channel", "part"))), F.lit(0.0), lambda a, x: a + x["part"])
    return both.groupBy("query_id", "doc").agg(F.round(fold, PLACES).alias("score"))


def depth(weights: list[float], constant: float, k: int) -> int:
    """How many places of each ranking the first k are among the candidates of, whatever the rankings.

    A ranking of k documents or more lifts k of them to its weight / (constant + k) at least; a document that stands in
    no ranking's first places gets less than all weights / (constant + depth). Shorter rankings are seen whole.
    """
    used = [w for w in weights if w]
    return int(sum(used) / min(used) * (constant + k) - constant) + 1


def fused_top(scores: list[DataFrame], weights: list[float], constant: float, k: int) -> DataFrame:
    """query_id, rank, doc, score: the first k of fused() over whole rankings, which are not made.

    scores: (query_id, doc, score) each, written; a ranking is by score, then document. Only the first depth() places of
    each are ordered. Their documents have bounds: known places count, unknown ones count as the first one unseen. For
    those whose upper bound reaches the k-th lower one, the places that are still unknown are counted: one more than
    the hits of the query that stand before it, an aggregate that is summed before it is shuffled.
    """
    used = [(s.select("query_id", "doc", "score"), float(w)) for s, w in zip(scores, weights, strict=True) if w]
    deep = depth([w for _, w in used], constant, k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    heads = [s.withColumn("rank", place).where(F.col("rank") <= deep).select("query_id", "doc", F.lit(i).alias("channel"), "rank") for i, (s, _) in enumerate(used)]
    names = [f"rank_{i}" for i in range(len(used))]
    seen = reduce(DataFrame.unionByName, heads).groupBy("query_id", "doc").agg(*[F.max(F.when(F.col("channel") == i, F.col("rank"))).alias(n) for i, n in enumerate(names)])
    part = lambda n, w, other: F.coalesce(w / (constant + F.col(n)), F.lit(other))
    bound = lambda unknown: sum((part(n, w, w * unknown) for n, (_, w) in zip(names, used, strict=True)), F.lit(0.0))
    seen = seen.withColumn("lower", bound(0.0)).withColumn("upper", bound(1 / (constant + deep + 1)))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    bars = seen.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", F.col("lower").alias("bar"))
    able = session.written(seen.join(bars, "query_id", "left").where(F.col("upper") >= F.coalesce("bar", F.lit(0.0)) - 10.0**-PLACES).select("query_id", "doc", *names), "fused-candidates")
    for n, (s, _) in zip(names, used, strict=True):
        wanted = s.join(able.where(F.col(n).isNull()).select("query_id", "doc"), ["query_id", "doc"], "left_semi")
        before = wanted.select("query_id", F.col("doc").alias("this"), F.col("score").alias("own")).join(s, "query_id").where((F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("doc") <= F.col("this"))))
        counted = before.groupBy("query_id", F.col("this").alias("doc")).agg(F.count("*").cast("int").alias("counted"))
        able = able.join(counted, ["query_id", "doc"], "left").withColumn(n, F.coalesce(n, "counted")).drop("counted")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return able.withColumn("score", F.round(bound(0.0), PLACES)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc", "score")


def channel_ranks(candidates: DataFrame, values: dict[str, str]) -> DataFrame:
    """candidates (query_id, id, corpus_order) with rank_<channel> of each value column, best first, ties by corpus order."""
    out = candidates
    for channel, column in values.items():
        order = F.col(column).asc() if channel == "structural_order" else F.col(column).desc()
        out = out.withColumn(f"rank_{channel}", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "corpus_order")))
    return out


def explained(ranked: DataFrame, operation: str) -> DataFrame:
    """ranked with signals and score under the operation's policy."""
    constant, weights = POLICY.get(operation, DEFAULT)
    parts = signal_parts({c: F.col(f"rank_{c}") for c in CHANNELS}, dict(zip(CHANNELS, weights, strict=True)), constant)
    return ranked.withColumn("signals", parts).withColumn("score", total(F.col("signals")))


def replayed(explained_rows: DataFrame, disabled: tuple[str, ...] = (), limit: int = 5) -> DataFrame:
    """The ranking without some channels: rank and selected. No expected result is accepted here."""
    if not set(disabled) <= set(CHANNELS) or not 1 <= limit <= 5:
        raise ValueError("unknown channel or limit outside 1..5")
    out = explained_rows.withColumn("score", F.when(F.size("signals") > 0, total(F.col("signals"), disabled)).otherwise(F.col("score")))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_order")))
    return out.withColumn("selected", F.col("rank") <= limit)


def stages(replay: DataFrame, gold: DataFrame, readers: DataFrame | None = None) -> DataFrame:
    """Where each gold id (query_id, id, kind, k) was lost: candidate_missing, ranking_loss, ranking_position_loss, reader_drop or retrieved.

    readers: (query_id, id) that a reader kept of the selected ones; null if no reader was asked.
    """
    met = gold.join(replay.select("query_id", "id", "rank", "selected"), ["query_id", "id"], "left")
    late = ((F.col("kind") == "exact_symbol") & (F.col("rank") > 1)) | ((F.col("kind") == "in_top_k") & (F.col("rank") > F.coalesce("k", F.lit(5))))
    stage = F.when(F.col("rank").isNull(), "candidate_missing").when(~F.col("selected"), "ranking_loss").when(late, "ranking_position_loss")
    if readers is not None:
        met = met.join(readers.select("query_id", "id", F.lit(True).alias("read")), ["query_id", "id"], "left")
        stage = stage.when(F.col("read").isNull(), "reader_drop")
    return met.withColumn("stage", stage.otherwise("retrieved")).drop("read")


def gold_ids(kind: Column, target: Column, wanted: Column) -> Column:
    """The ids that an expectation names: one for exact_symbol and in_top_k, all for exact_set and contains, none for others."""
    none = F.array().cast("array<string>")
    one = F.when(target.isNotNull() & (target != ""), F.array(target)).otherwise(none)
    return F.when(kind.isin("exact_symbol", "in_top_k"), one).when(kind.isin("exact_set", "contains"), F.coalesce(wanted, none)).otherwise(none)


def served(replay: DataFrame, score: DataFrame, runs: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Runs (payload, parent_id) of replayed rankings: case, frozen order and score, which is joined only after the order is fixed.

    replay: rows of replayed() with case_id; score: (query_id, score). parents: (case_id, parent_id); a parent of
    another case, or one that runs (id, payload) lacks, fails the batch.
    """
    frozen = replay.groupBy("query_id", "case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    rows = frozen.join(score, "query_id", "left")
    payload = F.to_json(F.struct("case_id", "query_id", "ids", "score"), {"ignoreNullFields": "false"})
    if parents is None:
        return rows.select(payload.alias("payload"), F.lit(None).cast("string").alias("parent_id"))
    known = runs.select(F.col("id").alias("parent_id"), F.get_json_object("payload", "$.case_id").alias("parent_case"))
    met = rows.join(parents, "case_id", "left").join(known, "parent_id", "left")
    wrong = F.col("parent_id").isNotNull() & ~F.col("parent_case").eqNullSafe(F.col("case_id").cast("string"))
    return met.select(F.when(wrong, F.raise_error(F.lit("a parent run of another case"))).otherwise(payload).alias("payload"), "parent_id")
