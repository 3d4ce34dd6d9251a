"""Scores of rankings against expectations, grouped reports, paired comparisons, bootstrap and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import session

#: Parts at least that counted values are dealt to by range.
PARTS = 64
# Weights of the task categories.
WEIGHTS = {"Completion": 0.32, "BugFix": 0.22, "Refactor": 0.12, "TestGen": 0.10, "FeatureAdd": 0.10, "ApiDiscovery": 0.14}


def expected_score(kind: Column, returned: Column, target: Column, k: Column, wanted: Column) -> Column:
    """exact_symbol, in_top_k, contains and exact_set (F1); any other kind scores 0."""
    got, want = F.array_distinct(returned), F.array_distinct(wanted)
    both = F.size(F.array_intersect(got, want))
    size = F.size(got) + F.size(want)
    return (
        F.when(kind == "exact_symbol", F.coalesce((F.get(returned, F.lit(0)) == target).cast("double"), F.lit(0.0)))
        .when(kind == "in_top_k", F.array_contains(F.slice(returned, F.lit(1), F.greatest(F.coalesce(k, F.lit(5)), F.lit(0))), target).cast("double"))
        .when(kind == "contains", F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.filter(wanted, lambda x: F.array_contains(returned, x))) / F.size(wanted)))
        .when(kind == "exact_set", F.when(size == 0, 1.0).otherwise(2 * both / size))
        .otherwise(0.0)
    )


def category_summary(scores: DataFrame) -> DataFrame:
    """scores (category, score): n, passed and mean of each category; the row without category has raw and weighted means."""
    each = scores.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0.999).alias("passed"), F.avg("score").alias("average"), F.sum("score").alias("total"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("category")], F.lit(0.0))
    whole = each.agg(F.sum("n").alias("n"), F.sum("passed").alias("passed"), (F.sum("total") / F.sum("n")).alias("average"), (F.sum(weight * F.col("average")) / F.nullif(F.sum(weight), F.lit(0.0))).alias("weighted"))
    return each.drop("total").withColumn("weighted", F.lit(None).cast("double")).unionByName(whole.withColumn("category", F.lit(None).cast("string")).select("category", "n", "passed", "average", "weighted"))


def retrieval_metrics(rows: DataFrame) -> DataFrame:
    """rows (ids, gold arrays) with hit, recall (null without gold), mrr and full_evidence over the first five."""
    five = F.slice("ids", 1, 5)
    found = F.size(F.array_intersect(five, F.col("gold")))
    n = F.size(F.array_distinct("gold"))
    first = F.array_min(F.filter(F.transform("gold", lambda g: F.array_position(five, g)), lambda p: p > 0))
    return rows.select("*", (found > 0).alias("hit"), F.when(n > 0, found / n).alias("recall"), F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"), ((found == n) & (n > 0)).alias("full_evidence"))


def grouped_report(rows: DataFrame) -> DataFrame:
    """Means by profile, by profile and category, and by profile and conversation in one pass of grouping sets."""
    return rows.groupingSets([[F.col("profile")], [F.col("profile"), F.col("category")], [F.col("profile"), F.col("conversation")]], F.col("profile"), F.col("category"), F.col("conversation")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr")
    )


def paired(rows: DataFrame, metrics: list[str], reference: str, others: list[str]) -> DataFrame:
    """Wins, losses and ties of each other profile against the reference, by question and metric."""
    pair = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    flat = rows.select("question_id", "profile", pair.alias("m")).select("question_id", "profile", "m.*")
    a = flat.where(F.col("profile").isin(*others))
    b = flat.where(F.col("profile") == reference).select("question_id", "metric", F.col("value").alias("base"))
    met = a.join(b, ["question_id", "metric"])
    return met.groupBy("profile", "metric").agg(F.count_if(F.col("value") > F.col("base")).alias("wins"), F.count_if(F.col("value") < F.col("base")).alias("losses"), F.count_if(F.col("value") == F.col("base")).alias("ties"))


def percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median, the mean of the two middle values of an even number, and nearest-rank 95th percentile of each group.

    Equal values are counted first. The counts are dealt to parts by range, at splitters that Spark finds in the values
    themselves, so that a part holds about as many values as another however they are spread; only parts that hold a
    wanted rank are ordered. So no task orders all values of a group.
    """
    key = F.concat_ws("|", *[F.concat(F.col(c).isNull().cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in by])
    counts = rows.select(*by, key.alias("__key"), F.col(value).cast("double").alias("v")).groupBy(*by, "__key", "v").agg(F.count("v").alias("n"))
    parts = max(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = session.written(counts.repartitionByRange(parts, "__key", "v").withColumn("part", F.spark_partition_id()), "counts")
    whole = counts.groupBy(*by, "__key").agg(F.sum("n").cast("long").alias("n"))
    ends = whole.select("__key", (F.floor((F.col("n") - 1) / 2)).alias("m0"), (F.floor(F.col("n") / 2)).alias("m1"), (F.ceil(F.col("n") * 0.95) - 1).alias("p"))
    placed = counts.where("n > 0").join(ends, "__key")
    held = placed.groupBy("__key", "part").agg(F.sum("n").alias("held"), F.first("m0").alias("m0"), F.first("m1").alias("m1"), F.first("p").alias("p"))
    held = held.withColumn("before", F.sum("held").over(Window.partitionBy("__key").orderBy("part")) - F.col("held"))
    inside = lambda c: (F.col(c) >= F.col("before")) & (F.col(c) < F.col("before") + F.col("held"))
    wanted = held.where(inside("m0") | inside("m1") | inside("p")).select("__key", "part", "before")
    last = F.col("before") + F.sum("n").over(Window.partitionBy("__key", "part").orderBy("v"))
    ranked = placed.join(wanted, ["__key", "part"]).withColumn("last", last)
    at = lambda c: F.max(F.when((F.col(c) < F.col("last")) & (F.col(c) >= F.col("last") - F.col("n")), F.col("v")))
    found = ranked.groupBy("__key").agg(((at("m0") + at("m1")) / 2).alias("p50"), at("p").alias("p95"))
    return whole.join(found, "__key", "left").select(*by, "p50", "p95", "n")


def cluster_bootstrap(spark: SparkSession, deltas: DataFrame, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """Mean and 95 % interval of deltas (cluster, delta) when clusters are drawn with replacement.

    A draw's cluster is a hash of seed, sample and draw; draws are made on executors and meet the clusters' numbered
    sums in a join.
    """
    sums = deltas.groupBy("cluster").agg(F.sum("delta").alias("total"), F.count("*").alias("n"))
    numbered = sums.withColumn("k", F.row_number().over(Window.orderBy("cluster")) - 1).checkpoint()
    clusters = numbered.count()
    draws = spark.range(samples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(max(clusters - 1, 0)))).alias("draw"))
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("sample").cast("string"), F.col("draw").cast("string")))
    picked = draws.select("sample", (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") % max(clusters, 1)).cast("int").alias("k"))
    means = picked.join(numbered, "k").groupBy("sample").agg((F.sum("total") / F.sum("n")).alias("mean"))
    bounds = means.agg(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY mean)").alias("low"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY mean)").alias("high"))
    return deltas.agg(F.avg("delta").alias("mean")).crossJoin(bounds)


def confusion(rows: DataFrame, by: str = "mode") -> DataFrame:
    """rows (mode, expected, found booleans): tp, fp, fn, precision and recall, null on an empty base."""
    c = lambda e, f: F.count_if((F.col("expected") == e) & (F.col("found") == f))
    out = rows.groupBy(by).agg(c(True, True).alias("tp"), c(False, True).alias("fp"), c(True, False).alias("fn"))
    return out.select("*", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))


def missing_runs(rows: DataFrame, questions: DataFrame, profiles: list[str]) -> DataFrame:
    """(question_id, profile) that a complete run would have and rows lack; profiles are a short closed list."""
    every = questions.select("question_id", F.explode(F.array(*[F.lit(p) for p in profiles])).alias("profile"))
    return every.join(rows.select("question_id", "profile"), ["question_id", "profile"], "left_anti")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
