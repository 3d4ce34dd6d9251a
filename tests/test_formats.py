"""File formats, code projections and the workspace service on small inputs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from factloom import session
from factloom.operators import codegraph, codesearch, evaluation, factgraph, fusion, journal, runs, workspace
from factloom.sources import files
from factloom.streaming import journal_stream, rooms


@pytest.fixture(autouse=True)
def shipped(spark):
    session.ship(spark)


SOURCE = "class Base:\n    def run(self):\n        return go()\n\ndef go():\n    x = Base\n    return x().run()\n"


def projection(folder):
    one = lambda symbol, role, place, around=None: {"symbol": symbol, "symbolRoles": role, "range": place} | ({"enclosingRange": around} if around else {})
    symbols = [{"symbol": "a/Base#", "relationships": []}, {"symbol": "a/Base#run().", "relationships": [{"symbol": "a/go().", "isImplementation": True}, {"symbol": "a/none().", "isImplementation": True}]}, {"symbol": "a/go().", "relationships": []}]
    seen = [one("a/Base#", 1, [0, 6, 10], [0, 0, 2, 19]), one("a/Base#run().", 1, [1, 8, 11], [1, 4, 2, 19]), one("a/go().", 1, [4, 4, 6], [4, 0, 6, 20]), one("a/go().", 0, [2, 15, 17]), one("a/Base#", 0, [5, 8, 12]), one("a/Base#run().", 0, [6, 15, 18]), one("a/gone().", 0, [6, 1, 2])]
    (folder / "code").mkdir()
    (folder / "code/a.py").write_text(SOURCE)
    (folder / "projection.json").write_text(json.dumps({"documents": [{"relativePath": "a.py", "symbols": symbols, "occurrences": seen}]}, indent=1))


def test_a_projection_becomes_a_graph_with_witnesses(spark, tmp_path):
    projection(tmp_path)
    symbols, related, seen = files.projection_tables(files.json_document(spark, str(tmp_path / "projection.json"), files.PROJECTION))
    held = codegraph.graph(symbols, related, seen, files.texts(spark, str(tmp_path / "code")))
    assert {(r.src, r.dst, r.freq, r.calls) for r in held["edges"].collect()} == {("a/Base#run().", "a/go().", 1, 1), ("a/go().", "a/Base#", 1, 0), ("a/go().", "a/Base#run().", 1, 1)}
    assert {(r.interface, r.implementor) for r in held["implements"].collect()} == {("a/go().", "a/Base#run().")}
    shown = {(r.src, r.dst): (r.first_line, r.text.strip(), r.available) for r in held["references"].collect()}
    assert shown["a/go().", "a/Base#"] == (6, "x = Base", True) and shown["a/Base#run().", "a/go()."] == (3, "return go()", True)
    asked = [("1", "implementors", "a/go()."), ("2", "callers", "file:a.py"), ("3", "callers", "a/go()."), ("4", "guess", "a/go()."), ("5", "file_symbols", "a.py"), ("6", "orphans", "function"), ("7", "contained_by", "a/Base#"), ("8", "callees", "a/go().")]
    queries = spark.createDataFrame(asked, "query_id string, operation string, target string")
    got = {}
    for r in codegraph.search(queries, held).orderBy("place").collect():
        got.setdefault(r.query_id, []).append(r.id)
    every = ["a/Base#", "a/Base#run().", "a/go()."]
    assert got == {"1": ["a/Base#run()."], "2": every, "3": ["a/Base#run()."], "5": every, "7": ["a/Base#run()."], "8": ["a/Base#run()."]}
    assert codegraph.search(queries, held, 1).where("query_id = '5'").count() == 1 and codegraph.search(queries, held, -1).isEmpty()
    documents = spark.createDataFrame([(n, i, i, "a.py", n) for n, i in enumerate(every)], "doc long, id string, text string, source string, definition_line int")
    question = spark.createDataFrame([("q", "who calls go", "a/go().")], "query_id string, text string, target string")
    found = spark.createDataFrame([("q", "a/Base#run().", 1, 1)], "query_id string, id string, place int, frequency int")
    row = codesearch.routed(question, found, documents, codegraph.degree(held["edges"]), "callers", references=held["references"], definitions=held["definitions"]).first()
    assert row.route == "references_incoming" and [(d.first_line, d.text.strip(), d.available) for d in row.definitions] == [(2, "def run(self):", True)]
    assert row.edge.source == "a/Base#run()." and row.edge.target == "a/go()." and [w.text.strip() for w in row.witnesses] == ["return go()"] and row.source == "a.py"
    assert [r.id for r in codegraph.in_corpus_order(spark.createDataFrame([("t", "zz"), ("t", "a/go()."), ("t", "a/Base#")], "target string, id string"), held["catalogue"]).orderBy("place").collect()] == ["a/Base#", "a/go().", "zz"]


def test_witnesses_of_missing_sources_line_ends_and_long_ranges(spark):
    import hashlib

    sources = spark.createDataFrame([("a", "x()\r\ny\rz\u2028w\n\n"), ("empty", "")], "path string, text string")
    assert sorted((r.path, r.line, r.line_text) for r in codegraph.source_lines(sources).collect()) == [("a", 0, "x()"), ("a", 1, "y"), ("a", 2, "z"), ("a", 3, "w"), ("a", 4, "")]
    one = [("a", 1, [0, 0, 3]), ("a", 2, [1, 0, 3, 1]), ("a", 3, [4, 0, 1]), ("a", 4, [9, 0, 1]), ("a", 5, [3, 0, 9, 0]), ("a", 6, [1]), ("empty", 1, [0, 0, 1]), ("gone", 1, [0, 0, 1, 1])]
    places = spark.createDataFrame(one, "path string, point int, r array<int>").select("path", "point", codegraph.bounds(F.col("r")).alias("bounds"))
    got = {(r.path, r.point): (r.first_line, r.last_line, r.text, r.available, r.source_hash) for r in codegraph.witnesses(places, sources).collect()}
    a, nothing = hashlib.sha256("x()\r\ny\rz\u2028w\n\n".encode()).hexdigest(), hashlib.sha256(b"").hexdigest()
    assert got == {
        ("a", 1): (1, 1, "x()", True, a), ("a", 2): (2, 4, "y\nz\nw", True, a), ("a", 3): (5, 5, "", True, a), ("a", 4): (10, 10, "", True, a), ("a", 5): (4, 10, "w\n", True, a), ("a", 6): (1, 0, "", True, a),
        ("empty", 1): (1, 1, "", False, nothing), ("gone", 1): (1, 2, "", False, nothing),
    }


def test_ranges_of_three_and_four_numbers(spark):
    rows = spark.createDataFrame([([1, 2, 5],), ([1, 2, 3, 4],), ([1],)], "r array<int>").select(codegraph.bounds(F.col("r")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in rows] == [(1, 2, 1, 5), (1, 2, 3, 4), None]


def test_timed_users_numbered_facts_and_sinks(spark, tmp_path):
    user = {"uuid": "u", "sessions": [{"memory_points": [{"memory_content": "a", "timestamp": "Sep 4, 2025, 19:05:11", "is_update": "False", "original_memories": []}, {"memory_content": "b", "timestamp": "Sep 5, 2025, 19:05:11", "is_update": "True", "original_memories": ["a"]}], "questions": [{"question": "q", "question_type": "t", "evidence": ["a"]}], "end_time": "Sep 6, 2025, 00:00:00"}]}
    (tmp_path / "users.jsonl").write_text(json.dumps(user) + "\n")
    points, questions = files.timed_points(files.json_lines(spark, str(tmp_path / "users.jsonl"), files.TIMED_USERS))
    assert [(r.owner, r.session, r.text, r.closes) for r in points.orderBy("pos").collect()] == [("u", 0, "a", []), ("u", 0, "b", ["a"])] and questions.first().question_type == "t"
    facts = factgraph.numbered_facts(spark.createDataFrame([("s", "0. One is two.\nnot a fact\n 12.  Three. ")], "source string, text string"))
    assert [(r.doc, r.text) for r in facts.orderBy("doc").collect()] == [(0, "One is two."), (2, "Three.")]
    rows = spark.createDataFrame([(1, None, "x"), (2, "b", "y")], "n int, s string, detail string")
    files.write_json(rows, str(tmp_path / "out"), ("detail",))
    assert sorted((r.n, r.s) for r in files.json_lines(spark, str(tmp_path / "out"), "n int, s string").collect()) == [(1, None), (2, "b")]
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_json(rows, str(tmp_path / "out"))
    with gzip.open(tmp_path / "z.json.gz", "wt") as z:
        z.write('{"n": 2, "s": "b"}\n{"n": 1}\n')
    assert files.same_rows(spark, str(tmp_path / "out"), str(tmp_path / "z.json.gz"), "n int, s string")
    rows.write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int").write.parquet(str(tmp_path / "sources"))
    assert files.parquet(spark, str(tmp_path / "p")).count() == 2 and [r.n for r in files.parquet(spark, str(tmp_path / "sources"), ["b"]).collect()] == [2]


def test_answers_in_facts(spark):
    facts = spark.createDataFrame([(1, "Ada lives in New York."), (2, "nothing")], "doc int, text string")
    found = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "query_id int, rank int, doc int")
    expected = spark.createDataFrame([(1, ["new york", ""]), (2, [""])], "query_id int, answers array<string>")
    assert {r.query_id: r.hit for r in factgraph.answered(found, facts, expected).collect()} == {1: True, 2: False}


def test_gold_ids_and_served_runs(spark):
    rows = spark.createDataFrame([("exact_symbol", "a", None), ("contains", None, ["b", "c"]), ("in_top_k", None, None), ("other", "a", ["b"])], "kind string, target string, wanted array<string>")
    assert [r.g for r in rows.select(fusion.gold_ids(F.col("kind"), F.col("target"), F.col("wanted")).alias("g")).collect()] == [["a"], ["b", "c"], [], []]
    replay = spark.createDataFrame([(1, "case", "x", 1), (1, "case", "y", 2)], "query_id int, case_id string, id string, rank int")
    score = spark.createDataFrame([(1, 0.5)], "query_id int, score double")
    empty = spark.createDataFrame([], runs.SCHEMA)
    first = runs.new_runs(fusion.served(replay, score, empty), empty).cache()
    assert json.loads(first.first().payload) == {"case_id": "case", "query_id": 1, "ids": ["x", "y"], "score": 0.5}
    parent = spark.createDataFrame([("other", first.first().id)], "case_id string, parent_id string")
    with pytest.raises(Exception, match="another case"):
        fusion.served(replay.withColumn("case_id", F.lit("other")), score, first, parent).collect()


def test_rooms_from_creation_to_replacement(spark, tmp_path):
    lab = rooms.Rooms(spark, str(tmp_path / "journal"), "lab")
    room, other = lab.create(), lab.create()
    steps = (rooms.Step("blue", 3, "note/1", "someone", "It is blue."), rooms.Step("green", 4, "note/2", "someone else", "It is green."))
    seen = lambda known=None: lab.snapshot(room, "wall", 4, known)
    with pytest.raises(ValueError, match="unknown"):
        lab.facts("0" * 32)
    with pytest.raises(ValueError, match="missing"):
        lab.step(room, 3, "wall", steps)
    assert seen()[0].first().answer == "unknown"
    for step, answer in ((1, "supported"), (2, "conflict"), (2, "conflict"), (3, "supported"), (3, "supported")):
        lab.step(room, step, "wall", steps)
        assert seen()[0].first().answer == answer
    assert lab.events(room).count() == 3 and lab.facts(other).isEmpty()
    assert seen(2)[0].first().answer == "conflict" and seen(0)[0].first().n_selected == 0
    assert sorted(r.reason for r in seen()[1].collect()) == ["active", "superseded"]
    ids = [r.id for r in lab.facts(room).collect()]
    with pytest.raises(ValueError, match="two facts"):
        lab.replace(other, ids[0], ids[1], 42)
    for bad in ({"value": ["x"]}, {"value": "x" * 501}, {"value": 1, "predicate": "likes"}, {"value": 1, "valid_from": 101}, {"value": 1, "source": "s" * 301}):
        with pytest.raises(Exception, match="scalar|limits|whole number|characters"):
            lab.save(other, "e", **({"source": "s", "text": "t"} | bad))
    assert lab.facts(other).isEmpty() and journal_stream.revision(spark, str(tmp_path / "journal")) == 3


def test_seeded_cases_fixtures_and_recall_keys(spark):
    cases = spark.createDataFrame([(1, "lib", "1", "2", "a.py", "x = 1")], "case_id int, entity string, original string, changed string, source string, text string")
    facts, proposals = workspace.seeded(cases)
    rows = journal.derived(facts, journal.replacements(proposals, facts), workspace.knowledge_coordinates(spark, [0, 1])).collect()
    assert {(r.coordinate, r.value_json): r.status for r in rows} == {(c, "1"): "superseded" if c == 12 else "active" for c in (0, 1, 2, 10, 11, 12)} | {(c, "2"): "active" if c > 9 else "not_yet_valid" for c in (1, 2, 11, 12)}
    fixture = spark.createDataFrame([("f", '{"b": 1, "a": 2}')], "name string, payload string").withColumn("content_hash", F.sha2(F.lit('{"a":2,"b":1}'), 256))
    assert workspace.intact(fixture).count() == 1
    with pytest.raises(Exception, match="differs"):
        workspace.intact(fixture.withColumn("content_hash", F.lit("0"))).collect()
    key = lambda revision, mode: runs.recall_key("1", revision, 3, "t", {"repository": "r"}, None, mode)
    assert key(1, "combined") == key(1, "combined") != key(2, "combined") and key(1, "combined") != key(1, "temporal")


def test_frozen_runs_are_checked_scored_and_compared(spark):
    asked = spark.createDataFrame([("q1", 1), ("q2", 1)], "question_id string, conversation_id long")
    calls = []

    def search(questions, profile):
        calls.append(profile)
        assert "answer_text" not in questions.columns
        return questions.select("question_id", F.lit("D1:1" if profile == "a" else "D1:2").alias("dia_id"), F.lit(1).alias("rank"))

    held = evaluation.frozen(asked, ["a", "b"], search, 2).cache()
    assert held.count() == 4 and sorted(calls) == ["a", "a", "b", "b"]
    known = spark.createDataFrame([("q1", ["D1:1", "D1:2"]), ("q2", ["D1:1"])], "question_id string, known array<string>")
    assert {(r.question_id, r.profile, r.flaw) for r in evaluation.checked(held, asked, known, ["a", "b"]).collect()} == {("q2", "b", "unknown id")}
    lost = held.where("NOT (question_id = 'q1' AND profile = 'a')").unionByName(held.where("question_id = 'q2' AND profile = 'a'"))
    assert {(r.profile, r.flaw) for r in evaluation.checked(lost, asked, known, ["a", "b"]).collect()} >= {("a", "twice"), ("a", "missing")}
    labels = spark.createDataFrame([("q1", 1, "When was it?", 1, ["D01:002"], "8 May, 2023"), ("q2", 1, "Who?", 5, ["D1:1"], None)], "question_id string, conversation_id long, question string, category int, evidence array<string>, answer_text string")
    rows = evaluation.scored(held.withColumn("answer", F.lit("2023-05-08").cast("date")), labels).cache()
    got = {(r.question_id, r.profile): (r.hit, r.lure, r.date_correct) for r in rows.collect()}
    assert got == {("q1", "a"): (0.0, None, True), ("q1", "b"): (1.0, None, True), ("q2", "a"): (None, True, None), ("q2", "b"): (None, False, None)}
    results = evaluation.outcomes(rows, ["a"])
    assert {(r.profile, r.metric, r.wins, r.losses, r.ties) for r in evaluation.paired_matrix(results).collect()} == {("b", m, 1, 0, 0) for m in evaluation.METRICS}
    assert [r.question_id for r in evaluation.win_examples(results, "hit").collect()] == ["q1"]
    assert evaluation.control(held, held).isEmpty() and {r.flaw for r in evaluation.control(held, held.where("profile = 'a'").withColumn("ids", F.array(F.lit("D1:2")))).collect()} == {"missing", "different"}
    one = {r.profile: r.digest for r in evaluation.ranking_digest(held).collect()}
    assert one == {r.profile: r.digest for r in evaluation.ranking_digest(held.repartition(5)).collect()} and one["a"] != one["b"]
    told = evaluation.manifest({"labels": labels, "runs": held.drop("turn")}, {"top": "5"}).first()
    assert [t["name"] for t in told.tables] == ["labels", "runs"] and told.parameters == {"top": "5"} and told.tables[1]["rows"] == 4
    assert spark.range(1).select(evaluation.question_key(F.lit("c"), F.lit(7))).first()[0] == "c/qa/007"
    expected = spark.createDataFrame([(1, "BugFix", "exact_symbol", "x", None, [])], "query_id int, category string, kind string, target string, k int, wanted array<string>")
    replay, record = spark.createDataFrame([(1, "x", 1)], "query_id int, id string, rank int"), spark.createDataFrame([(1, ["x"])], "query_id int, ids array<string>")
    assert {(r.category, r.passed, r.agree) for r in evaluation.task_report(replay, expected, record).collect()} == {("BugFix", 1, 1), (None, 1, 1)}
