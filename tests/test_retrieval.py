"""Text functions, dates, dialogue, code graph, fusion, fact chains and metrics on small inputs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom import session
from factloom.functions import text as fx
from factloom.operators import codegraph, codesearch, dates, dialogue, factgraph, fusion, journal, lexical, metrics
from factloom.sources import files
from factloom.streaming import journal_stream


@pytest.fixture(autouse=True)
def shipped(spark):
    session.ship(spark)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_tokenisers_differ(spark):
    t = F.lit("She was reading getHTTPName my_value stories 42")
    assert one(spark, fx.conversation_terms(t)) == ["read", "gethttpname", "value", "storie", "42"]
    assert one(spark, fx.code_tokens(F.lit("getHTTPName my_value 7"))) == ["gethttpname", "get", "http", "name", "my_value", "my", "_value", "my", "value", "7"]
    assert one(spark, fx.benchmark_tokens(t))[:2] == ["she", "reading"]
    assert one(spark, fx.normalised(F.lit("A--b  C!"))) == "a b c"
    assert one(spark, fx.sentences(F.lit("One. Two!  Three?"))) == ["One.", "Two!", "Three?"]


def test_symbol_grammar(spark):
    for symbol, kind, name, path in [("a/Query#", "struct", "Query", "Query"), ("a/Query#run().", "function", "run", "Query#run"), ("a/run().(x)", "parameter", "x", ""), ("file:a.py", "file", None, None), ("a/x.", "term", "x", "x"), ("a/mod:", "module", "mod", "mod:")]:
        assert one(spark, fx.symbol_kind(F.lit(symbol))) == kind
        if name:
            assert one(spark, fx.display_name(F.lit(symbol))) == name and one(spark, fx.descriptor_path(F.lit(symbol))) == path


def test_paths_and_ids(spark):
    assert one(spark, fx.clean_path(F.lit(".\\a\\b.py"))) == "a/b.py"
    assert one(spark, fx.dialogue_ids(F.lit("D01:002 and D10:3, D1:2"))) == ["D10:3", "D1:2"]
    assert one(spark, fx.gold_date(F.lit("7th May, 2023"))) == date(2023, 5, 7) and one(spark, fx.gold_date(F.lit("May 2023"))) is None


@pytest.mark.parametrize(
    "text, ref, first, last, precision",
    [
        ("on 29 February 2024", None, date(2024, 2, 29), date(2024, 2, 29), "day"),
        ("May 3rd, 2021", None, date(2021, 5, 3), date(2021, 5, 3), "day"),
        ("the day before yesterday", date(2024, 1, 1), date(2023, 12, 30), date(2023, 12, 30), "day"),
        ("two weeks ago", date(2024, 1, 31), date(2024, 1, 14), date(2024, 1, 20), "approximate_week"),
        ("last month", date(2024, 1, 15), date(2023, 12, 1), date(2023, 12, 31), "month"),
        ("next week", date(2024, 1, 3), date(2024, 1, 8), date(2024, 1, 14), "calendar_week_assumption"),
    ],
)
def test_dates(spark, text, ref, first, last, precision):
    got = spans(spark, text, ref)
    assert [(g["first"], g["last"], g["precision"]) for g in got] == [(first, last, precision)]


def spans(spark, text, ref):
    row = spark.createDataFrame([(text, ref)], "t string, d date")
    return row.select((dates.times("t", "d") if ref else dates.explicit_times(F.col("t"))).alias("s")).first().s


def test_dates_that_are_none(spark):
    assert spans(spark, "30 February 2024", None)[0]["precision"] == "month"
    assert spans(spark, "May 0000, yesterday, 300 days ago", None) == [] and spans(spark, None, None) == [] and spans(spark, "300 days ago", date(2024, 1, 1)) == []


def test_earlier_rules_claim_their_places(spark):
    got = spans(spark, "Yesterday, on 5 May 2023 and in May 2024, two weeks ago in 1999, the day after tomorrow", date(2024, 6, 1))
    assert [(g.expression, g.rule) for g in got] == [("Yesterday", "relative_day"), ("5 May 2023", "explicit_date"), ("May 2024", "explicit_month"), ("two weeks ago", "relative_ago"), ("1999", "explicit_year"), ("the day after tomorrow", "compound_relative_day")]
    assert [g.offset for g in got] == [0, 14, 32, 42, 59, 65] and got[0].first == date(2024, 5, 31)


def talk(spark, *lines):
    rows = [(1, s, p, f"D{s}:{p}", who, text, date(2023, 5, 8)) for s, p, who, text in lines]
    return spark.createDataFrame(rows, "conversation_id long, session int, pos int, dia_id string, speaker string, text string, session_date date")


def ask(spark, eps, question):
    return dialogue.asked(spark.createDataFrame([("q", 1, question)], "question_id string, conversation_id long, question string"), eps)


def test_windows_and_links_stay_in_a_session(spark):
    turns = talk(spark, (1, 1, "Ann", "It rains."), (1, 2, "Bob", "I like it."), (2, 1, "Ann", "Tell them."))
    assert {r.dia_id: r.context_ids for r in dialogue.windows(turns, 1).collect()} == {"D1:1": ["D1:1", "D1:2"], "D1:2": ["D1:1", "D1:2"], "D2:1": ["D2:1"]}
    assert {r.dia_id: r.previous_id for r in dialogue.previous_links(turns).collect()} == {"D1:1": None, "D1:2": "D1:1", "D2:1": None}


def test_plans_reports_and_subjects(spark):
    turns = dialogue.with_people(talk(spark, (1, 1, "Ann", "I will paint tomorrow. Bob cooked! Why? Nice."), (1, 2, "Bob", "ok")))
    got = [(r.sentence, r.modality, r.subjects, r.normalized_time) for r in dialogue.sentence_events(turns).where("pos = 1").orderBy("place").collect()]
    assert got == [("I will paint tomorrow.", "planned", ["Ann"], "9 May 2023"), ("Bob cooked!", "reported", ["Bob"], ""), ("Nice.", "reported", [], "")]


def test_bridge_follows_a_question_to_its_response(spark):
    turns = talk(spark, (1, 1, "Ann", "Bob, where did you adopt the puppy?"), (1, 2, "Bob", "From a shelter near the old harbour."), (1, 3, "Ann", "Lovely weather today."), (2, 1, "Bob", "The puppy sleeps."))
    eps = dialogue.episodes(turns).cache()
    got = dialogue.bridged(ask(spark, eps, "Where did Bob adopt the puppy?"), eps, dialogue.settings("answer_bridge") | {"kept": 1}).orderBy("rank").collect()
    assert "D1:2" in [r.dia_id for r in got if r.tier == 1]


def test_date_reader_and_calendar(spark):
    turns = talk(spark, (1, 1, "Ann", "I visited the museum on 3 May 2023."), (1, 2, "Bob", "I slept."), (2, 1, "Ann", "I sang a song in June 2023."))
    eps = dialogue.episodes(turns).cache()
    q = ask(spark, eps, "When did Ann visit the museum?")
    assert dialogue.date_answers(q, dialogue.searched(q, eps, "guarded")).first().answer == date(2023, 5, 3)
    q = ask(spark, eps, "When did Ann sing a song?")
    assert dialogue.date_answers(q, dialogue.searched(q, eps, "guarded")).first().reason == "non_day_or_ambiguous_time"
    q = ask(spark, eps, "What happened to Ann in June 2023 with jewels?")
    assert "D2:1" in [r.dia_id for r in dialogue.rescued(q, eps, dialogue.settings("calendar_unique")).collect()]


def test_turns_with_flaws_and_without_words(spark):
    turns = talk(spark, (1, 1, "Ann", "Hello there."), (1, 1, "Ann", "Again."), (2, 1, " ", "Who?"))
    assert sorted(r.dia_id for r in dialogue.flawed(turns).collect()) == ["D1:1", "D1:1", "D2:1"]
    docs = spark.createDataFrame([(1, "the of"), (2, "")], "doc long, text string")
    assert lexical.bm25(spark.createDataFrame([(1, "the fox")], "query_id int, text string"), docs, fx.benchmark_tokens).isEmpty()
    assert one(spark, fx.question_clause(F.lit("It rained. Well - where did you go?"))) == "where did you go?"


def test_employment_history(spark):
    turns = talk(spark, (1, 1, "Ann", "I work at Blue Mill."), (2, 1, "Ann", "I no longer work at Blue Mill."), (3, 1, "Ann", "I work at Blue Mill, again"))
    assert [(r.active, r.replaces) for r in dialogue.employment(turns).orderBy("session").collect()] == [(True, None), (False, "D1:1"), (True, "D2:1")]


def test_call_targets_are_names_not_receivers():
    assert codegraph.call_target_spans("def f(request):\n    return request.form(g(1))\n") == [(1, 19, 1, 23), (1, 24, 1, 25)] and codegraph.call_target_spans("def (") == []


def test_graph_operations(spark):
    ids = ["file:a.py", "a/mod:", "a/Base#", "a/Base#run().", "a/Base#run().(x)", "a/Sub#", "a/go().", "a/_hid()."]
    cat = codegraph.catalogue(spark.createDataFrame([(s, i, "./a.py") for i, s in enumerate(ids)], "id string, ord long, source_path string"))
    assert {(r.parent, r.child) for r in codegraph.containment(cat).collect()} == {("a/Base#", "a/Base#run().")}
    refs = spark.createDataFrame([("a/go().", "a/Base#run().", 1, True), ("a/go().", "a/Base#run().", 2, False), ("a/go().", "a/go().", 3, True), ("a/Base#run().", "a/Sub#", 4, False)], "src string, dst string, place int, is_call boolean")
    edges = codegraph.reference_edges(refs)
    assert {(r.src, r.dst, r.freq, r.calls) for r in edges.collect()} == {("a/go().", "a/Base#run().", 2, 1), ("a/Base#run().", "a/Sub#", 1, 0)}
    target = spark.createDataFrame([("a/Base#run().",)], "target string")
    assert [r.id for r in codegraph.callers(target, edges).collect()] == ["a/go()."] and codegraph.callees(target, edges).count() == 0
    assert [r.id for r in codegraph.orphans(cat, edges, codegraph.degree(edges)).orderBy("key").collect()] == ["a/go().", "a/_hid()."]
    found = codegraph.lookup(spark.createDataFrame([(1, "Base#run", True, None), (2, "Sub", True, "class"), (3, "a/go().", False, None), (4, "Bas", True, None)], "query_id int, name string, bare boolean, kind string"), cat)
    assert {(r.query_id, r.id) for r in found.collect()} == {(1, "a/Base#run()."), (2, "a/Sub#"), (3, "a/go().")}


def test_scope_is_the_innermost(spark):
    scopes = spark.createDataFrame([("f", "outer", (0, 0, 9, 0), 0), ("f", "inner", (2, 0, 4, 0), 1)], f"path string, scope string, bounds {codegraph.BOUNDS}, ord int")
    points = spark.createDataFrame([("f", 1, 3, 0), ("f", 2, 4, 0), ("g", 3, 1, 0)], "path string, point int, line int, column int")
    assert {r.point: r.scope for r in codegraph.innermost_scope(points, scopes).collect()} == {1: "inner", 2: "outer", 3: "file:g"}


def test_replay_without_a_channel_and_stages(spark):
    rows = spark.createDataFrame([(1, "a", 0, 1, 9.0), (1, "b", 1, 2, 99.0)], "query_id int, id string, corpus_order int, found int, v double")
    rows = rows.selectExpr("*", "v AS w", "v AS x", "v AS y")
    ranked = fusion.channel_ranks(rows, {"structural_order": "found", "bm25": "v", "edge_frequency": "w", "graph_degree": "x", "id_overlap": "y"})
    full = fusion.explained(ranked, "callers")
    assert [r.id for r in fusion.replayed(full).orderBy("rank").collect()] == ["b", "a"]
    assert [r.id for r in fusion.replayed(full, ("bm25", "edge_frequency", "graph_degree")).orderBy("rank").collect()] == ["a", "b"]
    gold = spark.createDataFrame([(1, "a", "exact_symbol", None), (1, "z", "contains", None)], "query_id int, id string, kind string, k int")
    assert {r.id: r.stage for r in fusion.stages(fusion.replayed(full), gold).collect()} == {"a": "ranking_position_loss", "z": "candidate_missing"}
    with pytest.raises(ValueError):
        fusion.replayed(full, ("nothing",))


def test_two_hops_reach_what_words_miss(spark):
    lines = ["The author of Dune is Ada.", "Ada is a citizen of Norland.", "Norland is located in the continent of Europa.", "Zed plays the position of keeper."]
    facts = spark.createDataFrame(list(enumerate(lines)), "doc long, text string")
    got = factgraph.multi_hop(spark.createDataFrame([(1, "continent of the country of the author of Dune")], "query_id int, text string"), facts, 4)
    assert {0, 1, 2} <= {r.doc for r in got.collect()}


def test_updates_close_the_latest_open_point(spark):
    points = spark.createDataFrame([("u", 1, "x", 10, []), ("u", 2, "X!", 20, []), ("u", 3, "y", 30, ["x"]), ("u", 4, "z", 40, ["x", "x"]), ("u", 5, "x", 50, [])], "owner string, pos int, text string, since int, closes array<string>")
    assert {r.pos: r.until for r in factgraph.linked_updates(points).collect()} == {1: 40, 2: 30, 3: None, 4: None, 5: None}


def test_equal_documents_tie_by_id(spark):
    docs = spark.createDataFrame([(2, "red fox"), (1, "red fox"), (3, "blue")], "doc long, text string")
    got = lexical.top(lexical.bm25(spark.createDataFrame([(1, "fox red red")], "query_id int, text string"), docs, fx.benchmark_tokens), 5).orderBy("rank").collect()
    assert [r.doc for r in got] == [1, 2] and got[0].score == got[1].score


def test_percentiles_equal_the_engine_s_own(spark):
    import random

    draw = random.Random(2)
    rows = [(g, None if draw.random() < 0.1 else float(draw.choice([draw.randrange(40), draw.gauss(0, 1e6)]))) for g in ("a", "b", None) for _ in range(301)] + [("one", 5.0), ("same", 2.0), ("same", 2.0), ("same", 2.0), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v double")
    want = table.groupBy("g").agg(F.median("v").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p95"), F.count("v").alias("n"))
    assert {r.g: (r.p50, r.p95, r.n) for r in metrics.percentiles(table, "v", ["g"]).collect()} == {r.g: (r.p50, r.p95, r.n) for r in want.collect()}


def test_percentiles_of_values_with_one_far_away(spark, monkeypatch):
    """One huge value does not press all others into one part."""
    sizes = []
    kept = session.written

    def written(df, name):
        out = kept(df, name)
        sizes.extend(r["count"] for r in out.groupBy("part").count().collect())
        return out

    monkeypatch.setattr(session, "written", written)
    rows = spark.range(30_000).select(F.lit("a").alias("g"), F.when(F.col("id") == 0, 1e15).otherwise(F.col("id") / 1000).alias("v"))
    row = metrics.percentiles(rows, "v", ["g"]).first()
    values = sorted([1e15, *(i / 1000 for i in range(1, 30_000))])
    assert (row.p50, row.p95, row.n) == ((values[14_999] + values[15_000]) / 2, values[28_499], 30_000) and max(sizes) < 3000


def test_bootstrap_is_seeded(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 2.0)], "cluster string, delta double")
    a, b = (metrics.cluster_bootstrap(spark, rows, 200).first() for _ in range(2))
    assert a == b and a.low <= a["mean"] <= a.high


def test_manifest_and_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    good = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    manifest = spark.createDataFrame([("a.txt", good), ("b.txt", good), ("../c", good)], "path string, sha256 string")
    assert {r.path: r.flaw for r in files.verified(spark, str(tmp_path), manifest).collect()} == {"b.txt": "missing", "../c": "outside"}
    got = files.texts(spark, str(tmp_path), spark.createDataFrame([("a.txt",), ("no",)], "path string"))
    assert {r.path: r.text for r in got.collect()} == {"a.txt": "hello", "no": ""}


def test_routes_fall_back_to_words(spark):
    docs = spark.createDataFrame([(0, "a/readFile().", "read file open"), (1, "a/closeFile().", "close file"), (2, "a/other().", "nothing"), (3, "a/more().", "more")], "doc long, id string, text string")
    queries = spark.createDataFrame([("s", "who calls readFile", "a/readFile()."), ("w", "close file", "a/none().")], "query_id string, text string, target string")
    found = spark.createDataFrame([("s", "a/other().", 1, 2), ("s", "a/closeFile().", 2, 1)], "query_id string, id string, place int, frequency int")
    degrees = spark.createDataFrame([("a/other().", 5)], "id string, degree long")
    rows = codesearch.routed(queries, found, docs, degrees, "callers").collect()
    assert [(r.id, r.route) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == "s"] == [("a/other().", "references_incoming"), ("a/closeFile().", "references_incoming")]
    words = [(r.id, r.route, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == "w"]
    assert words == [(i, "bm25_fallback", round(1 / (61 + n), 9)) for n, i in enumerate(["a/closeFile().", "a/readFile().", "a/other().", "a/more()."])]
    assert all(len(r.signals) == (5 if r.query_id == "s" else 0) for r in rows)
    assert {r.query_id for r in codesearch.routed(queries, found, docs, degrees, "lookup").collect()} == {"s"}
    overlap = {r.id: r.overlap for r in codesearch.id_overlap(queries, found).collect()}
    assert overlap == {"a/other().": 1, "a/closeFile().": 2}
    dense = spark.createDataFrame([("w", 3, 1)], "query_id string, doc long, rank int")
    assert codesearch.fallback(queries.where("query_id = 'w'"), docs.select("doc", "text"), dense).orderBy("rank").first().doc == 3


def test_bridge_keeps_questions_that_name_people_only(spark):
    turns = talk(spark, (1, 1, "Ann", "Bob, are you there?"), (1, 2, "Bob", "Here near the old harbour."), (2, 1, "Ann", "Fine."))
    eps = dialogue.episodes(turns).cache()
    settings = dialogue.settings("answer_bridge") | {"kept": 1}
    got = dialogue.bridged(ask(spark, eps, "Bob?"), eps, settings).collect()
    assert "D1:2" in [r.dia_id for r in got]
    assert [r.tier for r in dialogue.bridged(ask(spark, eps, "Bob?"), eps, settings | {"anchor": 0.1}).collect()].count(1) == 0


def test_episodes_and_employment_become_facts(spark, tmp_path):
    turns = talk(spark, (1, 1, "Ann", "I work at Blue Mill."), (2, 1, "Ann", "I no longer work at Blue Mill."), (2, 2, "Bob", "Oh."))
    eps = dialogue.episodes(turns).cache()
    path = str(tmp_path / "journal")
    journal_stream.append(dialogue.episode_facts(eps), path)
    assert journal_stream.held(spark, path).where("predicate = 'episode'").count() == 3
    said = journal.identified(dialogue.employment_facts(turns)).cache()
    journal_stream.append(said.drop("id", "session", "pos"), path)
    journal_stream.supersede(dialogue.employment_changes(said), path)
    here = spark.createDataFrame([(0, 1, "1", "conversation-history", "source-local-time"), (1, 2, "1", "conversation-history", "source-local-time")], "coordinate int, at long, repository string, branch string, environment string").withColumn("known", F.lit("2030-01-01").cast("timestamp"))
    rows = journal.derived(journal_stream.held(spark, path), journal_stream.held(spark, path, "replacements"), here).where("predicate = 'exists'")
    assert {(r.coordinate, r.value_json): r.status for r in rows.collect()} == {(0, "true"): "active", (0, "false"): "not_yet_valid", (1, "true"): "superseded", (1, "false"): "active"}
    other = dialogue.episodes(talk(spark, (1, 1, "Ann", "I work at Blue Mill!"), (2, 1, "Ann", "I no longer work at Blue Mill."), (2, 2, "Bob", "Oh.")))
    assert dialogue.index_hashes(eps).first().index_hash != dialogue.index_hashes(other).first().index_hash and dialogue.index_hashes(eps).collect() == dialogue.index_hashes(eps.repartition(3)).collect()


@pytest.mark.parametrize(
    "text, want",
    [("what by May 2024?", "2024-05-31 23:59:59"), ("on Feb 31, 2023 or 2022-01-01", "2023-02-28 23:59:59"), ("as of 2024-02-29", "2024-02-29 23:59:59"), ("nothing", "2021-01-01 10:00:00")],
)
def test_question_times(spark, text, want):
    got = one(spark, fx.question_time(F.lit(text), F.lit("2021-01-01 10:00:00").cast("timestamp")).cast("string"))
    assert got == want


def test_scopes_around_points_equal_a_search_of_all(spark):
    """Overlapping and nested scopes, empty and malformed ones, columns beyond all scopes, against every scope of the file."""
    import random

    rnd = random.Random(2)
    scopes, points = [("h", "few", (2, 3, 9, 9), 1), ("h", "fewer", (3, 0, 8, 9), 2)], []
    for path in ("f", "g"):
        for n in range(60):
            l0, l1 = rnd.randint(0, 30), rnd.randint(0, 30)
            scopes.append((path, f"{path}{n}", None if n == 7 else (min(l0, l1), rnd.randint(0, 12), max(l0, l1), rnd.randint(0, 12)), n))
    scopes.append(("one", "start", (0, 0, 0, 1), 0))
    points = [(path, n, rnd.randint(0, 32), rnd.choice([0, 3, 9, 12, 13, 400])) for n, path in enumerate(["f", "g", "h"] * 80)] + [("one", 1, 0, 0), ("one", 2, 0, 1), ("one", 3, None, 1)]
    places, around_ = spark.createDataFrame(points, "path string, point int, line int, column int"), spark.createDataFrame(scopes, "path string, scope string, bounds struct<l0:int,c0:int,l1:int,c1:int>, ord int")
    got = codegraph.innermost_scope(places, around_)
    held = places.join(around_, "path").where(codegraph.holds(F.col("bounds"), F.col("line"), F.col("column"))).select("path", "point").distinct()
    assert held.count() == got.where("NOT scope LIKE 'file:%'").count()
    want = {}
    for path, point, line, column in points:
        around = [((b[2] - b[0], b[3] - b[1], o), s) for p, s, b, o in scopes if p == path and b and line is not None and b[:2] <= (line, column) < b[2:]]
        want[path, point] = min(around)[1] if around else f"file:{path}"
    assert {(r.path, r.point): r.scope for r in got.collect()} == want and len(set(want.values())) > 20


def test_a_file_of_many_nested_scopes(spark):
    """100,000 points in 20,000 scopes within each other: what meets is a few rows for each point, where all pairs are 2,000,000,000."""
    n = 20_000
    scopes = spark.range(n).select(F.lit("f").alias("path"), F.col("id").alias("scope"), F.struct(F.col("id").cast("int").alias("l0"), F.lit(0).alias("c0"), (2 * n - F.col("id")).cast("int").alias("l1"), F.lit(0).alias("c1")).alias("bounds"), F.col("id").alias("ord"))
    points = spark.range(100_000).select(F.lit("f").alias("path"), F.col("id").alias("point"), (F.col("id") * 7 % (2 * n)).cast("int").alias("line"), (F.col("id") % 50).cast("int").alias("column"))
    found = codegraph.innermost_scope(points, scopes.withColumn("scope", F.col("scope").cast("string")))
    assert found.count() == 100_000
    assert found.where(F.col("scope") != F.least(F.col("line"), 2 * n - 1 - F.col("line"), F.lit(n - 1)).cast("string")).count() == 0


def test_memory_times(spark):
    assert str(one(spark, fx.memory_time(F.lit("Sep 4, 2025, 19:05:11")))) == "2025-09-04 19:05:11" and one(spark, fx.memory_time(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="not a memory time"):
        one(spark, fx.memory_time(F.lit("yesterday")))
    assert str(one(spark, dates.session_time(F.lit("1:56 pm on 8 May, 2023")))) == "2023-05-08 13:56:00"


def test_snapshots_do_not_see_later_updates(spark):
    rows = [("u", 1, 1, "likes tea", 10, []), ("u", 2, 2, "likes milk", 20, ["likes tea"]), ("u", 3, 3, "has a cat", 30, [])]
    points = factgraph.snapshot_links(spark.createDataFrame(rows, "owner string, session int, pos int, text string, since int, closes array<string>"))
    questions = spark.createDataFrame([(1, "u", 1, "what likes tea", 100), (2, "u", 2, "what likes tea", 100)], "question_id int, owner string, session int, text string, at int")
    found = factgraph.memory_search(points, questions)
    got = {(r.question_id, r.arm): [(x.point, x.stale) for x in sorted(found.where((F.col("question_id") == r.question_id) & (F.col("arm") == r.arm)).collect(), key=lambda x: x["rank"])] for r in found.select("question_id", "arm").distinct().collect()}
    assert got == {(1, "flat"): [(1, False)], (1, "temporal"): [(1, False)], (2, "flat"): [(1, True), (2, False)], (2, "temporal"): [(2, False)]}
    evidence = spark.createDataFrame([(1, ["Likes tea!"]), (2, ["likes tea"])], "question_id int, evidence array<string>")
    scores = factgraph.memory_metrics(found, points, evidence)
    assert {(r.question_id, r.arm): (r.hit, r.recall, r.stale) for r in scores.collect()} == {(1, "flat"): (True, 1.0, 0), (1, "temporal"): (True, 1.0, 0), (2, "flat"): (True, 1.0, 1), (2, "temporal"): (False, 0.0, 0)}
    total = factgraph.memory_report(scores, spark.createDataFrame([(1, "a"), (2, "b")], "question_id int, type string")).where("type IS NULL").first()
    assert (total.n, total.wins, total.losses, total.flat_stale_slots, total.temporal_stale_slots) == (2, 0, 1, 1, 0)


def test_memories_of_a_snapshot_equal_a_plain_search(spark, monkeypatch):
    """Statistics as of each session, late updates unseen, and rankings filled from points far down, against loops over whole snapshots."""
    import math
    import random

    monkeypatch.setattr(factgraph, "FIRST_SLICE", 2)
    rnd = random.Random(5)
    words = ["tea", "milk", "cat", "dog", "blue", "green"]
    rows = []
    for owner in ("u", "v"):
        for pos in range(60):
            text = "" if pos % 13 == 5 else " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
            rows.append((owner, pos // 7, pos, text, 10 * pos, [rows[-rnd.randint(1, 6)][3]] if pos > 6 and rnd.random() < 0.7 else []))
    points = factgraph.snapshot_links(spark.createDataFrame(rows, "owner string, session int, pos int, text string, since int, closes array<string>")).checkpoint()
    asked = [(n, rnd.choice("uvw"), rnd.randint(-1, 9), rnd.choice(["which cat cat drinks tea", "green", "nothing known", ""]), rnd.randint(0, 700)) for n in range(40)]
    got: dict = {}
    for r in factgraph.memory_search(points, spark.createDataFrame(asked, "question_id int, owner string, session int, text string, at int")).collect():
        got.setdefault((r.question_id, r.arm), {})[r["rank"]] = (r.point, r.stale)
    held, want = points.withColumn("toks", fx.benchmark_tokens("text")).collect(), {}
    tokens = {r.text: r.toks for r in spark.createDataFrame([(text,) for _, _, _, text, _ in asked], "text string").distinct().select("text", fx.benchmark_tokens("text").alias("toks")).collect()}
    for n, owner, last, text, at in asked:
        snap = [p for p in held if p.owner == owner and p.session <= last]
        docs = {p.pos: p.toks for p in snap}
        mean = (sum(map(len, docs.values())) / len(docs) if docs else 0) or 1.0
        terms = tokens[text]
        ranked = []
        for p in snap:
            score = 0.0
            for t in dict.fromkeys(terms):
                df, tf = sum(t in d for d in docs.values()), docs[p.pos].count(t)
                if tf:
                    score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[p.pos]) / mean))
                    score *= 1 + 0.05 * min(terms.count(t) - 1, 2)
            until = p["until"] if p.until_session is not None and p.until_session <= last else None
            ranked.append((-round(score, 6), p.pos, not (p.since <= at and (until is None or at < until))))
        ranked.sort()
        for arm, rows_ in (("flat", ranked), ("temporal", [r for r in ranked if not r[2]])):
            if rows_:
                want[n, arm] = {i + 1: (r[1], r[2]) for i, r in enumerate(rows_[:5])}
    assert got == want and any(any(p > 30 for p, _ in v.values()) for v in got.values())
    assert factgraph.memory_search(points.limit(0), spark.createDataFrame(asked, "question_id int, owner string, session int, text string, at int")).isEmpty()


def test_every_template_gives_its_ends(spark):
    rows = [(n, t.replace("(?:state in|the)", "the").replace("<s>", "Ada B").replace("<o>", "Cy D") + "." * (n % 2)) for n, t in enumerate(factgraph.TEMPLATES)] + [(99, "Nothing fits"), (100, None)]
    got = {r.doc: (r.e and (r.e.s, r.e.o)) for r in spark.createDataFrame(rows, "doc int, text string").select("doc", factgraph.endpoints(F.col("text")).alias("e")).collect()}
    assert got == {n: ("ada b", "cy d") for n in range(len(factgraph.TEMPLATES))} | {99: None, 100: None}


def test_closed_memories_in_a_stream(spark, tmp_path):
    from datetime import datetime

    rows = [("u", "x", datetime(2024, 1, d), shuts) for d, shuts in ((1, False), (2, False), (3, True), (4, True), (5, True))]
    spark.createDataFrame(rows, "owner string, key string, since timestamp, shuts boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("owner string, key string, since timestamp, shuts boolean").parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = journal_stream.linked(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert sorted((r.since.day, r.until.day) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 4), (2, 3)]
