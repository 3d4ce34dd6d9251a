"""Registered queries over small tables, against what all of their rows give."""

from datetime import datetime

import pytest

from factloom import session
from factloom.functions import text as fx
from factloom.operators import lexical
from factloom.plans import code, search
from factloom.sources import tables


@pytest.fixture(autouse=True)
def shipped(spark):
    session.ship(spark)


def stored(spark, folder, **tables):
    """A folder of the given tables: name=(rows, schema)."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_edges_are_of_all_line_items(spark, tmp_path):
    months = [datetime(1995, 3, 2), datetime(1998, 1, 5), datetime(1998, 2, 1), None]
    items = [(n, 1, n % 5, n % 3, "NRA"[n % 7 % 3], months[n % 4]) for n in range(60)] + [(100, 1, 7, 1, "N", months[0])]
    parts = [(n, f"name {n}", "brand", "type") for n in range(9)]
    here = stored(
        spark, tmp_path, lineitem=(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_shipdate timestamp"),
        part=(parts, "p_partkey long, p_name string, p_brand string, p_type string"), supplier=([(n, f"supplier {n}") for n in range(3)], "s_suppkey long, s_name string"),
    )
    want = {}
    for _, _, part, supplier, flag, _ in items:
        n, c = want.get((f"supplier-{supplier}", f"part-{part}"), (0, 0))
        want[f"supplier-{supplier}", f"part-{part}"] = n + 1, c + (flag != "N")
    assert {(r.src, r.dst): (r.freq, r.calls) for r in code.edge_frequency(spark, here).collect()} == want
    called = {e for e, (_, c) in want.items() if c}
    assert {(r.id, r.target) for r in code.callers(spark, here).collect()} == called == {(r.target, r.id) for r in code.callees(spark, here).collect()}
    assert {r.id for r in code.orphans(spark, here).collect()} == {f"part-{n}" for n in range(9)} - {d for _, d in called} == {"part-5", "part-6", "part-7", "part-8"}
    ends = [x for e in want for x in e]
    assert {r.id: r.degree for r in code.graph_degree(spark, here).collect()} == {x: ends.count(x) for x in ends}
    assert {(r.query_id.split("-")[0], r.route) for r in code.code_routes(spark, here).collect()} == {("part", "calls_incoming"), ("supplier", "bm25_fallback")}


def test_fusion_adds_ranks_of_whole_rankings(spark, tmp_path):
    docs = [(0, "reading" + " pad" * 40)] + [(n, "reads " * (1 + n % 3) + f"w{n}") for n in range(1, 50)] + [(n, "reading " + "pad " * n) for n in range(50, 90)]
    here = stored(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=([(1, "reading")], "item_id long, text string"))
    q, d = tables.corpus_queries(spark, here), tables.corpus(spark, here)
    total, words = {}, {}
    for weight, scores in ((1.0, lexical.bm25_boosted(q, d, fx.benchmark_tokens)), (0.5, lexical.bm25(q, d, fx.conversation_terms))):
        for rank, (_, doc) in enumerate(sorted((-r.score, r.doc) for r in scores.collect()), 1):
            total[doc] = total.get(doc, 0.0) + weight / (60 + rank)
        words = words or {r.doc: r.score for r in scores.collect()}
    want = sorted((-round(s, 9), doc) for doc, s in total.items())[:10]
    assert [(-r.score, r.doc) for r in sorted(search.rrf_fusion(spark, here).collect(), key=lambda r: r["rank"])] == want
    found = [doc for _, doc in want]
    places = [sorted(found, key=key).index for key in (found.index, lambda x: (-words.get(x, 0.0), x), lambda x: (-(x % 7), x), lambda x: (-(x % 5), x))]
    full = {x: round(sum(w / (61 + at(x)) for w, at in zip((1, 1, 1, 4), places, strict=True)), 9) for x in found}
    assert {r.id: r.full_score for r in search.signal_ablation(spark, here).collect()} == pytest.approx(full, abs=2e-9)


def test_questions_and_queries_are_of_whole_texts(spark, tmp_path):
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", "alpha beta gamma delta epsilon zeta eta theta") for c in range(20) for t in range(2)]
    item = " ".join(f"word{n}" for n in range(30))
    docs = [(1, "word29 " * 3), (2, "nothing here")]
    here = stored(spark, tmp_path, conversations=(talk, "conv_id long, turn long, role string, text string"), benchmark=([(5, item)], "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    asked = tables.questions(spark, here).collect()
    assert {r.question_id for r in asked} == {f"{c // 10}/D{c % 10 + 1}:{t + 1}" for c, t, _, _ in talk} and len(asked) == len(talk)
    assert all("alpha beta gamma delta epsilon zeta eta theta" in r.question for r in asked)
    assert [r.doc for r in search.bm25_repeat_boost(spark, here).collect()] == [1]
