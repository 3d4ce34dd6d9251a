"""What large inputs meet: plans that send nothing large through the driver, and work that is done once."""

from pyspark.sql import functions as F

from factloom.operators import codegraph

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scopes_are_not_broadcast(spark):
    """The planner takes exploded scopes for a few rows; none of them may go through the driver."""
    files = spark.range(50).select(F.col("id").cast("string").alias("path"))
    scope = F.explode(F.expr("transform(sequence(0, 40), i -> struct(concat('s', i) AS scope, named_struct('l0', i, 'c0', 0, 'l1', i + 2, 'c1', 5) AS bounds, i AS ord))")).alias("s")
    points = files.select("path", F.lit(1).alias("point"), F.lit(3).alias("line"), F.lit(1).alias("column"))
    found = codegraph.innermost_scope(points, files.select("path", scope).select("path", "s.*"))
    assert "Broadcast" not in plan(found)
    assert {r.scope for r in found.collect()} == {"s1"}


def test_lookups_read_no_source(spark, monkeypatch):
    from factloom.plans import code

    def refused(*_):
        raise AssertionError("a source was read")

    monkeypatch.setattr(codegraph, "source_lines", refused)
    monkeypatch.setattr(codegraph, "call_spans", refused)
    assert code.lookups(spark, SMALL).count() > 0


def test_sources_are_put_together_and_parsed_once(spark, monkeypatch):
    """Every reader of sources and called names reads a written table."""
    from factloom.plans import code

    names, keep = [], codegraph.session.written
    monkeypatch.setattr(codegraph.session, "written", lambda df, name: names.append(name) or keep(df, name))
    assert "MapInPandas" not in plan(code.projection_edges(spark, SMALL))
    assert {"projection", "sources", "spans"} <= set(names)


def test_pairs_of_questions_and_turns_are_not_shuffled(spark, monkeypatch):
    """They are scored, joined and ranked in cells, several to a large conversation; the session keeps its settings."""
    from datetime import date

    from factloom.operators import dialogue

    n, plans, keep = 150, {}, dialogue.session.written
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conversation_id"), F.lit(1).alias("session"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("D1:"), "id").alias("dia_id"), F.when(F.col("id") % 2 == 0, "Anna").otherwise("Ben").alias("speaker"), F.concat(F.lit("the word"), "id", F.lit(" is known.")).alias("text"), F.lit(date(2023, 1, 1)).alias("session_date"))
    eps = dialogue.episodes(turns).checkpoint()
    q = dialogue.asked(turns.select(F.col("dia_id").alias("question_id"), "conversation_id", F.concat(F.lit("what is word"), "pos").alias("question")), eps).checkpoint()
    monkeypatch.setattr(dialogue.session, "written", lambda df, name: plans.update({name: plan(df)}) or keep(df, name))
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    first = dialogue.searched(q, eps, "guarded").where("rank = 1")
    assert first.where("question_id = dia_id").count() == n and first.count() == n
    assert "ENSURE_REQUIREMENTS" not in plans["best"].replace("BroadcastExchange", "")
    assert dialogue.cells(q).dealt.count() > 1
    fused = dialogue.fused_context(q, eps, dialogue.settings("context_balanced"))
    assert fused.groupBy("question_id").count().where("count > 5").count() == 0 and fused.count() >= n
    assert "ENSURE_REQUIREMENTS" not in plans["context"].split("is_base")[-1] and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before


def test_a_frequent_word_does_not_pair_all_queries_with_all_documents(spark, monkeypatch):
    """The first documents by words are those of whole scores, ties and all; documents that are alike are met k at a time."""
    from factloom.functions import text as fx
    from factloom.operators import lexical

    k = 3
    said = F.when(F.col("id") % 50 == 0, F.concat(F.lit("common other n"), "id")).when(F.col("id") % 7 == 0, F.concat(F.lit("common common n"), "id")).otherwise(F.concat(F.lit("common n"), "id"))
    docs = spark.range(400).select(F.col("id").alias("doc"), said.alias("text")).checkpoint()
    queries = docs.where("doc % 5 = 0").select(F.col("doc").alias("query_id"), F.concat("text", F.lit(" common n7 other")).alias("text"))
    sizes, keep = {}, lexical.session.written
    monkeypatch.setattr(lexical.session, "written", lambda df, name: sizes.update({name: keep(df, name)}) or sizes[name])
    found = lexical.first_float(queries, lexical.indexed(docs, fx.code_tokens), fx.code_tokens, k)
    whole = lexical.top(lexical.bm25_float(queries, docs, fx.code_tokens), k)
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc, r.score) for r in df.collect())
    assert rows(found) == rows(whole) and found.count() == k * 80
    assert sizes["pairs"].count() <= 80 * (3 * k + 2 + 8)


def test_scores_arise_where_documents_are(spark, monkeypatch):
    """Whole scores are those of postings, to the last bit of single precision; no pair of a query and a document is shuffled, and of the first k a batch gives no more."""
    from factloom.functions import text as fx
    from factloom.operators import lexical

    said = F.when(F.col("id") == 5, F.lit(None)).otherwise(F.concat_ws(" ", F.lit("word word"), F.concat(F.lit("n"), F.col("id") % 7), F.concat(F.lit("m"), F.col("id") % 3), F.repeat(F.lit("pad "), (F.col("id") % 11).cast("int"))))
    docs = spark.range(60).select(F.col("id").alias("doc"), said.alias("text")).checkpoint()
    queries = spark.createDataFrame([(1, "n3 n3 n3 word m1 n3 none"), (2, "pad word pad"), (3, "none")], "query_id long, text string")
    every = {"plain": lexical.bm25, "boosted": lexical.bm25_boosted, "float": lexical.bm25_float}
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc", "score").collect()))
    names, keep = [], lexical.session.written
    monkeypatch.setattr(lexical.session, "written", lambda df, name: names.append(name) or keep(df, name))
    found = {way: search(queries, docs, fx.benchmark_tokens) for way, search in every.items()}
    assert "postings" not in names and not any("Exchange" in plan(df) for df in found.values())
    few = lexical.best(queries, docs, fx.benchmark_tokens, 4, boosted=True)
    assert lexical.bm25_boosted(queries, docs, fx.benchmark_tokens, first=4).count() < found["boosted"].count()
    monkeypatch.setattr(lexical, "SENT", 0)
    for way, search in every.items():
        assert rows(found[way]) == rows(search(queries, docs, fx.benchmark_tokens)) and len(rows(found[way])) > 60
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, lexical.best(queries, docs, fx.benchmark_tokens, 4, boosted=True).collect()))


def test_profiles_of_the_same_words_are_scored_once(spark, monkeypatch):
    """Both frozen profiles come from one index and rank as searched one by one; the audit of labels searches nothing."""
    from factloom.operators import dialogue
    from factloom.plans import dialogue as talk
    from factloom.plans import evaluation as plans

    names, keep = [], dialogue.session.written
    monkeypatch.setattr(dialogue.session, "written", lambda df, name: names.append(name) or keep(df, name))
    assert plans.evaluation_audit(spark, SMALL).count() > 0 and "postings" not in names
    rows, _, _ = plans.run(spark, SMALL)
    assert names.count("postings") == 1
    eps, q = talk.inputs(spark, SMALL)
    for profile in plans.PROFILES:
        found = dialogue.searched(q, eps, profile)
        ids = {}
        for r in sorted(found.select("question_id", "rank", "dia_id").collect()):
            ids.setdefault(r.question_id, []).append(r.dia_id)
        answers = {r.question_id: r.answer for r in dialogue.date_answers(q, found).collect()}
        got = rows.where(F.col("profile") == profile).collect()
        assert {r.question_id: r.ids for r in got if r.ids} == ids and {r.question_id: r.answer for r in got} == answers


def test_pairs_of_facts_take_more_tasks_as_facts_grow(spark, monkeypatch):
    """No task's share of the facts grows with the journal; answers read one written table."""
    from factloom.operators import journal
    from factloom.plans import journal as plans

    before = sorted(map(tuple, plans.situation_matrix(spark, SMALL).collect()))
    monkeypatch.setattr(journal, "SHARE", 50)
    n = plans.tables.assertions(spark, SMALL).count()
    assert f", {n // 50 + 1})" in plan(plans.tables.proposed_replacements(plans.tables.assertions(spark, SMALL)))
    names, keep = {}, journal.session.written
    monkeypatch.setattr(journal.session, "written", lambda df, name: names.setdefault(name, keep(df, name)))
    found = plans.situation_matrix(spark, SMALL)
    assert f", {names['answered'].count() // 50 + 1})" in plan(found) and sorted(map(tuple, found.collect())) == before


ODD = '''import a
@a.first(
    1)
def f(x):
    text = """
def g():
    h(
"""
    return longer_name_1(x).run(text)

if f(1):
    f(2)
else:
    f(3)
class A(make()):
    def m(self):
        return "\\N{LEFT SQUARE BRACKET}" + self.m(1.e1000)

    async def n(self):
        await other_name_of_it(match=1)

# end
@a
def last(): f(
    4)
'''


def test_syntax_trees_stay_small_and_keep_no_names(monkeypatch):
    """A source is parsed a few statements at a time, whatever pieces it comes in, with the spans of the whole; faulty ones have none."""
    import ast

    keep, sizes = codegraph.tree, []
    names = {n.id for n in ast.walk(codegraph.tree("customer1234(customer9876)")) if isinstance(n, ast.Name)}
    assert len(names) == 1
    monkeypatch.setattr(codegraph, "tree", ast.parse)
    monkeypatch.setattr(codegraph, "PIECE", 1 << 30)
    sources = [ODD * 30, ODD.replace("\n", "\r\n") * 3, "x = 1\r" + ODD, ODD.replace("a.first", "é.first"), ODD + "def (", "'''\n" + ODD, ODD + "\n  f()\n", ODD + "\\", "", "f()"]
    whole = [codegraph.call_target_spans(s) for s in sources]
    assert len(whole[0]) == 30 * 10 and [not w for w in whole[4:9]] == [True] * 5
    monkeypatch.setattr(codegraph, "tree", lambda code: sizes.append(len(code)) or keep(code))
    monkeypatch.setattr(codegraph, "PIECE", 100)
    for source, spans in zip(sources, whole, strict=True):
        cut = list(codegraph.cut_source(source))
        assert "".join(cut) == source and all(p.endswith("\n") for p in cut[:-1])
        assert sorted(codegraph.call_target_spans(source)) == sorted(codegraph.spans_of_pieces(cut)) == sorted(codegraph.spans_of_pieces(source.splitlines(keepends=True))) == sorted(spans)
    sizes.clear()
    assert len(codegraph.call_target_spans(ODD * 30)) == 30 * 10 and max(sizes) < 2 * len(ODD)


def test_sources_in_pieces_are_whole_sources(spark):
    """Lines, hash and calls of sources in pieces, some of which end within a statement, are those of whole ones."""
    texts = {"odd": ODD * 5, "broken": ODD + "def (\n" + ODD, "ends": "a()\x0c\nb() c = 1\r\nd()\n\ne()", "empty": ""}
    pieces = [(p, n, x) for p, t in texts.items() for n, x in enumerate(t.split("\n\n")) for x in [x + "\n\n" if n < t.count("\n\n") else x]]
    assert len(pieces) > 15
    whole = spark.createDataFrame(list(texts.items()), "path string, text string").repartition(3)
    apart = codegraph.in_pieces(spark.createDataFrame(pieces, "path string, piece int, text string").repartition(5)).checkpoint()
    rows = lambda df: sorted(map(str, df.collect()))
    for part in (codegraph.source_lines, codegraph.call_spans, codegraph.stamps):
        assert rows(part(whole)) == rows(part(apart)) == rows(part(codegraph.in_pieces(whole))) != []


def test_functions_of_a_nation_share_no_row(spark):
    """No row holds a whole source of a nation, and edges read no line of it."""
    from factloom.plans import code

    _, _, _, sources = code.tables.code_projection(spark, SMALL.replace("0.001", "0.1"))
    n = spark.read.parquet(SMALL.replace("0.001", "0.1") + "/customer.parquet").count()
    assert sources.agg(F.sum(F.regexp_count("text", F.lit("def ")))).first()[0] == n > 10_000
    assert sources.agg(F.max(F.length("text"))).first()[0] < 4 * codegraph.PIECE
    held = code.code_graph(spark, SMALL)
    assert held["edges"].count() > 0 and "lines" not in held and "references" not in held


def test_structural_search_reads_no_lines(spark, monkeypatch):
    """Its operations need called names, not lines, hashes or definitions; the catalogue is read by columns."""
    from factloom.plans import code

    names, keep = [], codegraph.session.written
    monkeypatch.setattr(codegraph.session, "written", lambda df, name: names.append(name) or keep(df, name))
    found = code.structural_search(spark, SMALL)
    assert {"spans", "called", "catalogue"} <= set(names) and not {"lines", "stamps", "references", "definitions"} & set(names)
    assert "ExistingRDD" not in plan(found) and found.count() > 0


def test_evidence_is_the_same_from_pieces_of_sources(spark, monkeypatch):
    """Definitions and the lines that speak for a candidate do not depend on where sources are cut; their hash is that of the whole source."""
    import hashlib

    from factloom.plans import code

    few = spark.read.parquet(f"{SMALL}/customer.parquet").count()
    found = {}
    for functions in (2, few):
        monkeypatch.setattr(code.tables, "FUNCTIONS", functions)
        found[functions] = sorted(map(str, code.code_evidence(spark, SMALL).collect()))
        held = code.code_graph(spark, SMALL)
        apart, whole = {}, {}
        for r in code.tables.code_projection(spark, SMALL)[3].orderBy("path", "piece").collect():
            whole[r.path] = whole.get(r.path, "") + r.text
            apart[r.path] = apart.get(r.path, 0) + 1
        assert (max(apart.values()) > 1) == (functions == 2)
        said = {(r.path, r.source_hash) for part in ("references", "definitions") for r in held[part].select("path", "source_hash").collect()}
        assert said == {(p, hashlib.sha256(t.encode()).hexdigest()) for p, t in whole.items()}
    assert found[2] == found[few] != []


def test_a_source_runs_through_its_hash_in_order(spark):
    """Pieces of a source that arrive in many batches and tasks are one witness's hash; a row for each path."""
    import hashlib

    from factloom.plans import code

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        rows = spark.range(300).select(F.concat(F.lit("p"), F.col("id") % 3).alias("path"), (300 - F.col("id")).alias("piece"), F.concat(F.lit("f("), "id", F.lit(")\n")).alias("text")).repartition(7)
        got = {(r.path, r.source_hash, r.available) for r in codegraph.stamps(codegraph.in_pieces(rows)).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {(f"p{k}", hashlib.sha256("".join(f"f({i})\n" for i in range(299, -1, -1) if i % 3 == k).encode()).hexdigest(), True) for k in range(3)}
    seen = code.projection_witnesses(spark, SMALL)
    assert seen.where("NOT available OR first_line <> last_line OR text = ''").isEmpty() and seen.count() > 0


def test_a_search_counts_edges_once(spark):
    """Its plan reads written edges; orphans of all kinds come from one pass."""
    from factloom.plans import code

    for query in (code.structural_search, code.code_evidence):
        assert plan(query(spark, SMALL)).count("Exchange") < 60
