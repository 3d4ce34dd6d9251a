"""The journal: identity, validation, replacement, recall, conflicts, runs and the streaming write path."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom import session
from factloom.operators import journal, runs, workspace
from factloom.streaming import journal_stream

SCHEMA = journal_stream.FACTS


def fact(value="1", start=0, end=None, day=1, entity="lib", predicate="default", env="prod", negated=False, source="doc"):
    return (entity, predicate, value, "repo", "main", env, start, end, datetime(2024, 5, day), json.dumps({"source": source}, separators=(",", ":")), negated)


def facts(spark, *rows):
    return journal.identified(spark.createDataFrame(list(rows), SCHEMA))


def here(spark, at, day, env="prod", n=0):
    return spark.createDataFrame([(n, at, datetime(2024, 5, day), "repo", "main", env)], "coordinate int, at long, known timestamp, repository string, branch string, environment string")


def replaced(spark, known, old, new, effective, day):
    ids = {r.value_json: r.id for r in known.collect()}
    proposal = spark.createDataFrame([(ids[old], ids[new], effective, datetime(2024, 5, day))], "old_id string, new_id string, effective long, recorded_at timestamp")
    return journal.replacements(proposal, known)


def none(spark):
    return spark.createDataFrame([], "old_id string, new_id string, effective long, recorded_at timestamp, id string")


def test_canonical_form_is_what_json_writes(spark):
    row = spark.createDataFrame([fact(value='"a\\"b"', entity='é "x"')], SCHEMA).select(journal.canonical().alias("c"), F.sha2(journal.canonical(), 256).alias("h")).first()
    got = json.loads(row.c)
    assert json.dumps(got, ensure_ascii=False, sort_keys=True, separators=(",", ":")) == row.c
    assert got["valid_to"] is None and got["recorded_at"] == "2024-05-01T00:00:00.000000+00:00"


def test_late_replacement_changes_only_later_knowledge(spark):
    known = facts(spark, fact("1", 0, day=1), fact("2", 5, day=2))
    events = replaced(spark, known, "1", "2", 5, 3)
    for day, status in ((2, "active"), (3, "superseded")):
        rows = journal.derived(known, events, here(spark, 7, day)).where("value_json = '1'").collect()
        assert [r.status for r in rows] == [status]
    assert journal.answers(journal.derived(known, events, here(spark, 7, 2)), here(spark, 7, 2), "combined").first().answer == "conflict"
    assert journal.answers(journal.derived(known, events, here(spark, 7, 3)), here(spark, 7, 3), "combined").first().answer == "supported"


def test_boundaries_scope_and_unknown_start(spark):
    known = facts(spark, fact("1", 3, 6), fact("2", None, None, predicate="calls"), fact("3", 0, None, env="dev"))
    at = lambda n: {r.value_json: r.status for r in journal.derived(known, none(spark), here(spark, n, 9)).collect()}
    assert at(2) == {"1": "not_yet_valid", "2": "unknown_validity"} and at(3)["1"] == "active" and at(6)["1"] == "expired"
    empty = journal.answers(journal.derived(known, none(spark), here(spark, 0, 9, "no")), here(spark, 0, 9, "no"), "combined").first()
    assert (empty.answer, empty.n_selected) == ("unknown", 0)


def test_negation_and_many_values(spark):
    known = facts(spark, fact("1", predicate="calls"), fact("2", predicate="calls"), fact("1", predicate="calls", negated=True, day=2))
    pairs = journal.pairs(journal.derived(known, none(spark), here(spark, 1, 9)), "combined").collect()
    assert len(pairs) == 1 and pairs[0].diagnosis == "conflict" and pairs[0].current


@pytest.mark.parametrize("bad", [fact(start=5, end=5), fact(start=None, end=4), fact(entity=" "), fact(source=""), fact(start=-1)])
def test_one_bad_fact_fails_the_batch(spark, bad):
    with pytest.raises(Exception, match="bad fact"):
        journal.fresh(spark.createDataFrame([fact(), bad], SCHEMA), facts(spark, fact("9"))).collect()


def test_append_is_idempotent(spark):
    known = facts(spark, fact("1"))
    assert [r.value_json for r in journal.fresh(spark.createDataFrame([fact("1"), fact("2"), fact("2")], SCHEMA), known).collect()] == ["2"]


def test_refusals_in_order(spark):
    known = facts(spark, fact("1", 0, day=1), fact("2", 5, day=2), fact("3", 0, day=2, predicate="calls"), fact("4", 0, day=2, predicate="calls"), fact("5", 0, 3, day=1))
    ids = {r.value_json: r.id for r in known.collect()}
    cases = [("1", "1", 5, 3, "effective"), ("1", "3", 5, 3, "other subject"), ("3", "4", 5, 3, "other value"), ("1", "2", 5, 1, "not yet recorded"), ("1", "2", 4, 3, "not yet valid"), ("5", "2", 5, 3, "already over"), ("1", "2", 5, 3, None)]
    rows = spark.createDataFrame([(ids[a], ids[b], e, datetime(2024, 5, d)) for a, b, e, d, _ in cases], "old_id string, new_id string, effective long, recorded_at timestamp")
    got = {(r.old_id, r.new_id, r.effective, r.recorded_at.day): r.refusal for r in journal.refusals(rows, known).collect()}
    assert got == {(ids[a], ids[b], e, d): why for a, b, e, d, why in cases}


def test_cycles_are_found_along_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")], "old_id string, new_id string")
    proposals = spark.createDataFrame([("d", "b"), ("d", "x"), ("a", "d")], "old_id string, new_id string")
    assert {(r.old_id, r.new_id) for r in journal.creates_cycle(proposals, edges).collect()} == {("d", "b"), ("d", "x")}


def cycles(spark, held, asked):
    frame = lambda rows: spark.createDataFrame(rows, "old_id long, new_id long")
    return {(r.old_id, r.new_id) for r in journal.on_cycles(frame(asked), frame(held + asked)).collect()}


def test_proposals_on_cycles_equal_a_walk(spark):
    """Random graphs: forests of chains, rings, several edges in and out, and cores that no contraction makes smaller."""
    rnd = random.Random(3)
    held = [(201, 202), (202, 203), (211, 212), (212, 213), (212, 219), (221, 222)]
    asked = [(203, 201), (204, 204), (213, 211), (212, 218), (231, 232)]
    for first, nodes, n_held, n_asked in ((0, 40, 20, 10), (50, 30, 30, 10), (100, 12, 30, 8)):
        more = {tuple(sorted(rnd.sample(range(first, first + nodes), 2))) for _ in range(n_held)}
        held += more
        asked += {tuple(rnd.sample(range(first, first + nodes), 2)) for _ in range(n_asked)} - more
    after = {}
    for a, b in held + asked:
        after.setdefault(a, set()).add(b)
    want = set()
    for old, new in asked:
        seen, todo = {new}, [new]
        while todo:
            more = after.get(todo.pop(), set()) - seen
            seen |= more
            todo += more
        want |= {(old, new)} if old in seen else set()
    assert {(203, 201), (204, 204), (213, 211)} <= want and (212, 218) not in want
    assert cycles(spark, held, asked) == want
    assert cycles(spark, [(1, 2)], []) == set()


def test_a_batch_against_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    written = session.written
    monkeypatch.setattr(session, "written", lambda df, name: (rounds.append(name), written(df, name))[1])
    chain = [(n, n + 1) for n in range(10_000)]
    asked = [(9_000, 10), (20_000, 5), (7_000, 20_001), (20_001, 20_002), (20_002, 6_000), (10_000, 20_003)]
    assert cycles(spark, chain, asked) == {(9_000, 10), (7_000, 20_001), (20_001, 20_002), (20_002, 6_000)}
    assert rounds.count("ways") < 20


def test_times_need_an_offset(spark):
    ok = spark.createDataFrame([("2024-05-01T02:00:00+02:00",), ("2024-05-01T00:00:00Z",)], "t string").select(journal.utc_text(journal.utc(F.col("t"))).alias("u")).collect()
    assert {r.u for r in ok} == {"2024-05-01T00:00:00.000000+00:00"}
    with pytest.raises(Exception, match="without offset"):
        spark.createDataFrame([("2024-05-01T00:00:00",)], "t string").select(journal.utc(F.col("t"))).collect()


def test_runs_are_immutable(spark):
    session.ship(spark)
    empty = spark.createDataFrame([], runs.SCHEMA)
    first = runs.new_runs(spark.createDataFrame([('{"b": 1, "a": [1.0, true]}', None)], "payload string, parent_id string"), empty).cache()
    row = first.first()
    assert row.payload == '{"a":[1.0,true],"b":1}' and runs.get(first, row.id) == row.payload
    with pytest.raises(KeyError):
        runs.get(first, "no")
    with pytest.raises(ValueError, match="differs"):
        runs.get(first.withColumn("payload", F.lit("{}")), row.id)
    with pytest.raises(Exception, match="unknown parent"):
        runs.new_runs(spark.createDataFrame([("{}", "nobody")], "payload string, parent_id string"), first).collect()


def test_recalls_are_held_by_key(spark):
    held = runs.Recalls(1)
    make = lambda: spark.range(3)
    assert [held.get("a", make)[1], held.get("a", make)[1], held.get("b", make)[1], held.get("a", make)[1]] == [False, True, False, False]


def test_workspace_guards_and_trace(spark):
    room = workspace.new_room()
    assert workspace.checked_room(room) == room and workspace.checked_text(" x ", 3) == "x" and workspace.checked_position(100) == 100
    for call in (lambda: workspace.checked_room("x"), lambda: workspace.checked_text(" ", 3), lambda: workspace.checked_text(" xxx ", 4), lambda: workspace.checked_position(True), lambda: workspace.checked_position(101)):
        with pytest.raises(ValueError):
            call()
    t = datetime(2024, 1, 1)
    assert workspace.next_time(t, t) > t and workspace.next_time(t, None) == t
    known = facts(spark, fact("1"), fact("2", day=8), fact("3", env="dev"), fact("4", entity="other"))
    assert {r.value_json: r.reason for r in workspace.trace(known, none(spark), here(spark, 1, 5), entity="lib").collect()} == {"1": "active", "2": "not_known", "3": "different_environment", "4": "different_entity"}
    with pytest.raises(Exception, match="too many"):
        workspace.within_limits(facts(spark, *[fact(str(i)) for i in range(81)])).collect()


def test_stream_appends_what_is_new_and_replays_nothing(spark, tmp_path):
    session.ship(spark)
    source, journal_path = str(tmp_path / "in"), str(tmp_path / "journal")
    spark.createDataFrame([fact("1"), fact("1"), fact("2")], SCHEMA).write.parquet(source)
    for n in range(2):
        q = journal_stream.written(spark.readStream.schema(SCHEMA).parquet(source), journal_path, str(tmp_path / "check"))
        q.awaitTermination(120)
        assert journal_stream.held(spark, journal_path).count() == 2 + n and journal_stream.revision(spark, journal_path) == 1 + n
        spark.createDataFrame([fact("2"), fact("3")], SCHEMA).write.mode("append").parquet(source)


def test_two_streams_and_new_checkpoints_lose_nothing(spark, tmp_path):
    session.ship(spark)
    path = str(tmp_path / "journal")
    for n, rows in enumerate(([fact("1"), fact("2")], [fact("3")], [fact("1"), fact("4")])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / f"in{n}"))
        journal_stream.written(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / f"in{n}")), path, str(tmp_path / f"check{n}")).awaitTermination(120)
    assert sorted(r.value_json for r in journal_stream.held(spark, path).collect()) == ["1", "2", "3", "4"]
    assert journal_stream.revision(spark, path) == 3
    journal_stream.append(spark.createDataFrame([fact("4")], SCHEMA), path)
    assert journal_stream.revision(spark, path) == 3


def test_replacements_and_runs_are_tables_of_the_journal(spark, tmp_path):
    session.ship(spark)
    path = str(tmp_path / "journal")
    journal_stream.append(spark.createDataFrame([fact("1"), fact("2"), fact("3")], SCHEMA), path)
    ids = {r.value_json: r.id for r in journal_stream.held(spark, path).collect()}
    ask = lambda *rows: spark.createDataFrame([(ids[a], ids[b], 1, datetime(2024, 5, 2)) for a, b in rows], journal_stream.PROPOSALS)
    journal_stream.supersede(ask(("1", "2")), path)
    journal_stream.supersede(ask(("1", "2"), ("2", "3")), path)
    assert journal_stream.held(spark, path, "replacements").count() == 2 and journal_stream.revision(spark, path) == 3
    with pytest.raises(Exception, match="cycle"):
        journal_stream.supersede(ask(("3", "1")), path)
    assert journal_stream.held(spark, path, "replacements").count() == 2
    journal_stream.save_runs(spark.createDataFrame([('{"a": 1}', None)], "payload string, parent_id string"), path)
    assert journal_stream.held(spark, path, "runs").count() == 1


def test_a_cycle_within_one_batch_is_refused(spark):
    known = facts(spark, fact("1"), fact("2"), fact("3"), fact("4"))
    ids = {r.value_json: r.id for r in known.collect()}
    asked = [("1", "2"), ("2", "1"), ("3", "4")]
    rows = spark.createDataFrame([(ids[a], ids[b], 1, datetime(2024, 5, 2)) for a, b in asked], "old_id string, new_id string, effective long, recorded_at timestamp")
    got = {(r.old_id, r.new_id): r.refusal for r in journal.judged(rows, known, none(spark)).collect()}
    assert got == {(ids["1"], ids["2"]): "cycle", (ids["2"], ids["1"]): "cycle", (ids["3"], ids["4"]): None}


def test_key_order_and_spaces_do_not_change_identity(spark):
    session.ship(spark)
    rows = [fact('{"a":1,"b":2}'), fact('{"b": 2, "a": 1}'), fact('{"b": 2,\n"a":1}'), fact('"x"'), fact(' "x" '), fact('"\\u0078"'), fact("1"), fact("1.0"), fact("1\n")]
    ids = [r.id for r in journal.identified(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.monotonically_increasing_id())).orderBy("n").collect()]
    assert len(set(ids[:3])) == 1 and len(set(ids[3:6])) == 1 and ids[6] == ids[8] != ids[7]
    loose = (*fact()[:9], '{ "text": "t", "source": "doc" }', False), (*fact()[:9], '{"source":"doc","text":"t"}', False)
    assert len({r.id for r in journal.identified(spark.createDataFrame(list(loose), SCHEMA)).collect()}) == 1


def test_plain_json_meets_no_python(spark, monkeypatch):
    """A parser that fails on plain JSON is never asked for it."""
    session.ship(spark)
    pattern = journal.PLAIN_JSON.replace(r"\z", r"\Z")

    def strict(values):
        import re

        if any(re.search(pattern, v) for v in values):
            raise ValueError("plain JSON in Python")
        return values.map(lambda v: json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True, separators=(",", ":")))

    loose = (*fact()[:2], "[1, 2]", *fact()[3:9], '{"b": 1, "a": 2}', False)
    rows = [fact(str(n)) for n in range(200)] + [fact('"x"'), fact("true"), loose]
    want = {r.id for r in journal.identified(spark.createDataFrame(rows, SCHEMA)).collect()}
    monkeypatch.setattr(journal, "canonical_value", lambda c: F.pandas_udf(strict, "string")(c))
    assert {r.id for r in journal.identified(spark.createDataFrame(rows, SCHEMA)).collect()} == want and len(want) == 203


def test_closure_equals_the_walk_along_edges(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "y"), ("y", "x"), ("x", "b")]
    table = spark.createDataFrame(edges, "old_id string, new_id string")
    got = {(r.source, r.node) for r in journal.closure(table).collect()}
    assert got == {(r.source, r.node) for r in journal.reachable(table, table.select(F.col("old_id").alias("source"))).collect()}
    assert ("a", "f") in got and ("x", "f") in got and ("x", "x") in got and len(got) == 6 + 5 + 4 + 3 + 2 + 7 + 7


def test_long_chains_are_followed_in_few_rounds(spark, monkeypatch):
    rounds = []
    kept = session.written
    monkeypatch.setattr(session, "written", lambda df, name: rounds.append(name) or kept(df, name))
    chain = spark.range(3000).select(F.col("id").alias("old_id"), (F.col("id") + 1).alias("new_id")).unionByName(spark.createDataFrame([(9000, 5), (9001, 7)], "old_id long, new_id long"))
    got = {r.source: (r.n_after, r.last_node) for r in journal.followed(chain).collect()}
    assert got == {n: (3000 - n, 3000) for n in range(3000)} | {9000: (2996, 3000), 9001: (2994, 3000)} and len(rounds) < 20
    with pytest.raises(ValueError, match="cycle"):
        journal.followed(spark.createDataFrame([(1, 2), (2, 1)], "old_id long, new_id long"))
    with pytest.raises(Exception, match="two edges"):
        journal.followed(spark.createDataFrame([(1, 2), (1, 3)], "old_id long, new_id long"))
    assert journal.followed(chain.limit(0)).isEmpty()


def test_places_run_on_through_a_history(spark):
    known = facts(spark, *[fact(str(n), day=1 + n // 3) for n in range(9)])
    rows = journal.timeline(known, none(spark)).orderBy("recorded_at", "ref").collect()
    assert [r.place for r in rows] == list(range(1, 10))
