"""The BM25 index and its bounded search against whole scores."""

import numpy as np

from factloom.functions import text as fx
from factloom.operators import fusion, lexical


def corpus(spark, n=400):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    odds = 1 / np.arange(1, 301)
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)), p=odds / odds.sum()))) for i in range(n)]
    docs += [(n + 1, None), (n + 2, ""), (n + 3, docs[5][1]), (n + 4, docs[5][1]), (n + 5, "w3 " * 50_000)]
    asked = [(q, docs[q * 7][1] + " w1 w1 w2 w2 w2") for q in range(12)] + [(90, "nowhere"), (91, "w250"), (92, None), (93, "")]
    return spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc long, text string")


def test_counts_within_a_row_equal_a_plain_count(spark):
    docs = spark.createDataFrame([(1, "b a b c b"), (2, ""), (3, None), (4, "x")], "doc long, text string")
    index = lexical.indexed(docs, fx.benchmark_tokens)
    assert sorted((r.term, r.doc, r.len, r.tf) for r in index.postings.collect()) == [("b", 1, 4, 3), ("c", 1, 4, 1), ("x", 4, 1, 1)]
    assert [(r.total, r["mean"]) for r in index.whole.collect()] == [(4, 1.25)]
    none = lexical.indexed(docs.limit(0), fx.benchmark_tokens)
    assert [(r.total, r["mean"]) for r in none.whole.collect()] == [(0, 1.0)] and none.postings.isEmpty()  # the fallback of an empty collection


def test_bounded_search_equals_whole_scores_and_reads_less(spark):
    queries, docs = corpus(spark)
    index = lexical.indexed(docs, fx.benchmark_tokens)
    some = docs.where("doc % 3 <> 0").select("doc")
    for boosted, allowed in ((False, None), (True, None), (True, some)):
        whole = (lexical.bm25_boosted if boosted else lexical.bm25)(queries, docs, fx.benchmark_tokens)
        want = sorted(tuple(r) for r in lexical.top(whole, 5, allowed).select("query_id", "rank", "doc", "score").collect())
        found = lexical.pruned(queries, index, fx.benchmark_tokens, 5, boosted, allowed)
        assert sorted(tuple(r) for r in found.rows.collect()) == want
    met = lexical.contributions(lexical.query_terms(queries, fx.benchmark_tokens), index).count()
    read = sum(r.n for r in lexical.pruned(queries, index, fx.benchmark_tokens, 1).read.collect())
    assert read < met / 2


def test_fusion_counts_places_that_stand_deep_in_a_ranking(spark):
    """The first documents of one ranking stand last in the other, queries have few hits, and scores tie."""
    rng = np.random.default_rng(2)
    rows = [[], [], []]
    for n in range(1500):
        rows[0].append((1, n, float(1500 - n)))
        rows[1].append((1, n, float(n) if n < 8 else float(rng.integers(8, 300))))
        rows[2].append((1, n, float(rng.integers(0, 5))))
        if n % 7:
            rows[1].append((2, n, float(rng.integers(0, 40))))
    rows[0] += [(2, n, 1.0) for n in range(3)] + [(3, 4, 2.0), (3, 5, 2.0)]
    frames = [spark.createDataFrame(r, "query_id long, doc long, score double") for r in rows]
    for weights, k in (([1.0, 0.5, 0.0], 10), ([1.0, 1.0, 0.25], 3)):
        whole = fusion.fused([lexical.top(f, None) for f in frames], weights, 60)
        want = sorted(tuple(r) for r in lexical.top(whole, k).select("query_id", "rank", "doc", "score").collect())
        got = sorted(tuple(r) for r in fusion.fused_top(frames, weights, 60, k).collect())
        assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 2e-9 for x, y in zip(got, want, strict=True))
    assert (1, 1, 0) in [x[:3] for x in sorted(tuple(r) for r in fusion.fused_top(frames, [1.0, 0.5, 0.0], 60, 10).collect())]
    assert fusion.depth([1.0, 0.5], 60, 10) == 151


def test_session_stamps(spark):
    from datetime import datetime

    from factloom.operators import dates

    said = ["1:56 pm on 8 May, 2023", "12:05 am on 29 February, 2024", "9:00 am on 31 April, 2023", "yesterday", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", dates.session_time(fx.F.col("s")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {0: datetime(2023, 5, 8, 13, 56), 1: datetime(2024, 2, 29, 0, 5), 2: None, 3: None, 4: None}


def test_differences_between_a_frozen_run_and_its_repetition(spark):
    from factloom.operators import metrics

    was = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int")
    now = spark.createDataFrame([("a", 1), ("b", 3)], "id string, v int")
    assert sorted(tuple(r) for r in metrics.differences(was, now).collect()) == [("a", 1, "left"), ("b", 2, "left"), ("b", 3, "right")]
    assert metrics.differences(was, was).isEmpty()
