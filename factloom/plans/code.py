"""Queries over the code graph, fact chains and timed memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import session
from factloom.functions import text as fx
from factloom.operators import codegraph, codesearch, factgraph, fusion, lexical
from factloom.sources import tables

from .search import BOOST, TOKENS, grouped_parts_sql, parts_sql, ranked


def edges(spark, sf_dir):
    return codegraph.reference_edges(tables.occurrences(spark, sf_dir))


def edge_frequency(spark, sf_dir):
    return edges(spark, sf_dir).select("src", "dst", "freq", "calls")


def callers(spark, sf_dir):
    e = edges(spark, sf_dir)
    return codegraph.callers(e.select(F.col("dst").alias("target")).distinct(), e)


def callees(spark, sf_dir):
    e = edges(spark, sf_dir)
    return codegraph.callees(e.select(F.col("src").alias("target")).distinct(), e)


def graph_degree(spark, sf_dir):
    return codegraph.degree(edges(spark, sf_dir))


def orphans(spark, sf_dir):
    """Parts that no line item calls."""
    part = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("ord"), F.lit("symbol").alias("kind"), F.col("p_name").alias("name"), F.col("p_name").alias("path"))
    e = edges(spark, sf_dir)
    return codegraph.orphans(part, e, codegraph.degree(e), "symbol").select("id")


def place_symbols(spark, sf_dir):
    """Regions as structs, nations as structs in them, customers as functions in nations."""
    r, n, c = (tables.table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    word = lambda x: F.regexp_replace(x, "[^A-Za-z0-9]", "_")
    a = r.select(F.concat(F.lit("geo/"), word("r_name"), F.lit("#")).alias("id"), F.col("r_regionkey").cast("long").alias("ord"))
    rn = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    nation = F.concat(F.lit("geo/"), word("r_name"), F.lit("#"), word("n_name"), F.lit("#"))
    b = rn.select(nation.alias("id"), (F.col("n_nationkey") + 100).cast("long").alias("ord"))
    d = c.join(rn, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(nation, word("c_name"), F.lit("().")).alias("id"), (F.col("c_custkey") + 1000).alias("ord"))
    return a.unionByName(b).unionByName(d).withColumn("source_path", F.lit("geo.py"))


def containment(spark, sf_dir):
    return codegraph.containment(codegraph.catalogue(place_symbols(spark, sf_dir))).select("parent", "child")


def contained_by(spark, sf_dir):
    cat = codegraph.catalogue(place_symbols(spark, sf_dir))
    return codegraph.contained_by(cat.where("kind = 'struct'").select(F.col("id").alias("target")), codegraph.containment(cat))


def innermost_scope(spark, sf_dir):
    """The smallest of an order's nested scopes around each line item: lines 10 n to 10 n + 9, and their halves."""
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"))
    scope = F.explode(F.expr("transform(sequence(0, 7), i -> struct(concat('s', i) AS scope, named_struct('l0', i * 2, 'c0', 0, 'l1', if(i % 2 = 0, i * 2 + 4, i * 2 + 1), 'c1', 5) AS bounds, i AS ord))")).alias("s")
    scopes = o.select("path", scope).select("path", "s.*")
    points = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("point"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 8).cast("int").alias("column"))
    return codegraph.innermost_scope(points, scopes).select("path", F.col("point.l_linenumber").alias("line"), F.col("point.l_partkey").alias("part"), F.col("point.l_suppkey").alias("supplier"), "scope")


def call_targets(spark, sf_dir):
    """Called names in sources rendered from parts: two calls, one through an attribute; nested ones in a method; or a source that does not parse."""
    plain = F.concat(F.lit("def f(x):\n    y = make_"), F.col("p_size").cast("string"), F.lit("(x)\n    return y.close(x.size)\n"))
    nested = F.concat(F.lit("class A:\n    def f(self):\n        return self.run(len(part_"), F.col("p_partkey").cast("string"), F.lit("))\n"))
    text = F.when(F.col("p_partkey") % 3 == 0, plain).when(F.col("p_partkey") % 3 == 1, nested).otherwise("def broken(:\n")
    src = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text"))
    return codegraph.call_spans(src).groupBy("path").agg(F.count("*").alias("n"), F.min("bounds.c0").alias("first_column"), F.max("bounds.c1").alias("last_column"))


def fact_endpoints(spark, sf_dir):
    """Ends of sentences of all templates."""
    e = factgraph.endpoints(F.col("text"))
    return tables.template_facts(spark, sf_dir).select("doc", e["s"].alias("subject"), e["o"].alias("object"))


def chain_questions(spark, sf_dir):
    return tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("What is the continent of the citizens of "), F.col("n_name")).alias("text"))


def multi_hop_rank(spark, sf_dir):
    return factgraph.multi_hop(chain_questions(spark, sf_dir).where(fx.nested_question(F.col("text"))), tables.relational_facts(spark, sf_dir))


def routed_evaluation(spark, sf_dir):
    """Questions along chains and plain ones about every nation: who finds its continent, by words and by the routed graph."""
    nation = tables.table(spark, sf_dir, "nation").join(tables.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    chain = F.concat(F.lit("What is the continent of the citizens of "), F.col("n_name"))
    asked = nation.select(F.explode(F.array(F.struct(F.col("n_nationkey").cast("long").alias("query_id"), F.lit("chain").alias("source"), chain.alias("text")), F.struct((F.col("n_nationkey") + 100).cast("long").alias("query_id"), F.lit("plain").alias("source"), F.concat(F.lit("Where is "), F.col("n_name")).alias("text")))).alias("q"), F.array("r_name").alias("answers")).select("q.*", "answers").checkpoint()
    facts = tables.relational_facts(spark, sf_dir)
    found = factgraph.routed(asked.select("query_id", "text"), facts)
    return factgraph.routed_report(factgraph.answered(found, facts, asked.select("query_id", "answers")).join(asked.select("query_id", "source"), "query_id"))


def points(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    text = F.concat("event_type", F.lit(" "), (F.floor("value").cast("long") % 3).cast("string"))
    return e.select(F.col("user_id").alias("owner"), F.col("event_id").alias("pos"), text.alias("text"), F.col("ts").cast("timestamp").alias("since"), F.when(F.col("event_id") % 3 == 0, F.array(text)).otherwise(F.array().cast("array<string>")).alias("closes"))


def update_linking(spark, sf_dir):
    return factgraph.linked_updates(points(spark, sf_dir)).select("owner", "pos", "since", "until")


def active_memory_topk(spark, sf_dir, k: int = 5):
    """BM25 over all documents, only those active at the query's time returned; documents hold for ten days from their own."""
    q = tables.corpus_queries(spark, sf_dir)
    scores = lexical.bm25_boosted(q, tables.corpus(spark, sf_dir), fx.benchmark_tokens)
    since = F.col("doc") % 30
    rows = scores.withColumn("at", F.col("query_id") % 30).where(factgraph.active(F.col("at"), since, since + 10))
    return lexical.top(rows, k).select("query_id", "rank", "doc", "score")


def code_routes(spark, sf_dir, k: int = 5):
    """Callers of parts and of suppliers, those whose number 20 divides, by five channels; what nobody calls is answered by words."""
    part = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    supplier = tables.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + (20 << 28)).alias("doc"), F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("text"))
    documents = part.unionByName(supplier)
    queries = documents.where(F.col("doc") % 20 == 0).select(F.col("id").alias("query_id"), F.concat_ws(" ", "id", "text").alias("text"), F.col("id").alias("target"))
    e = session.written(edges(spark, sf_dir), "edges")
    # most edges lead to what is not asked for
    near = session.written(e.join(queries.select(F.col("target").alias("dst")), "dst", "left_semi"), "near")
    found = codegraph.callers(queries.select("target"), near).where(F.col("place") <= codegraph.LIMIT)
    times = near.select(F.col("src").alias("id"), F.col("dst").alias("target"), codegraph.frequency(near, "callers").alias("frequency"))
    found = session.written(found.join(times, ["id", "target"]).select(F.col("target").alias("query_id"), "id", "place", "frequency"), "found")
    rows = codesearch.routed(queries, found, documents, codegraph.degree(e, ids=found.select("id").distinct()), "callers", mode="calls")
    return fusion.replayed(rows, (), k).where("selected").select("query_id", "id", "rank", "route", F.round("score", 6).alias("score"))


def code_graph(spark, sf_dir):
    return codegraph.graph(*tables.code_projection(spark, sf_dir))


def projection_edges(spark, sf_dir):
    """Edges of the graph of a rendered projection, from scopes, occurrences and the sources' calls."""
    return code_graph(spark, sf_dir)["edges"].select("src", "dst", "freq", "calls", F.col("first.point.part").alias("first_part"))


def projection_witnesses(spark, sf_dir):
    """Every reference with the line of source that shows it."""
    r = code_graph(spark, sf_dir)["references"]
    return r.select("src", "dst", "path", "first_line", "last_line", F.trim("text").alias("text"), "is_call", "available")


def structural_search(spark, sf_dir):
    """All operations, and one that does not exist, on the rendered graph; of callers those of a file as well."""
    held = code_graph(spark, sf_dir)
    cat = held["catalogue"]
    one = lambda op, c: F.struct(F.lit(op).alias("operation"), c.alias("target"))
    structs = cat.where("kind = 'struct'").select(F.explode(F.array(one("implementors", F.col("id")), one("file_symbols", F.col("source_path")), one("callers", F.concat(F.lit("file:"), F.col("source_path"))), one("orphans", F.lit("function")), one("guess", F.col("id")))).alias("q"))
    functions = cat.where("kind = 'function'").select(F.explode(F.array(one("callers", F.col("id")), one("callees", F.col("id")))).alias("q"))
    queries = structs.unionByName(functions).select("q.*").distinct().select(F.concat_ws("/", "operation", "target").alias("query_id"), "operation", "target")
    return codegraph.search(queries, held)


def code_evidence(spark, sf_dir):
    """Who refers to each function and what it refers to, with the edge, the first line that shows it, and where the candidate is defined."""
    held = code_graph(spark, sf_dir)
    ways = F.explode(fx.strings(["callers", "callees"])).alias("operation")
    queries = held["catalogue"].where("kind = 'function'").select(ways, F.col("id").alias("target")).select(F.concat_ws("/", "operation", "target").alias("query_id"), "operation", "target")
    found = session.written(codegraph.search(queries, held, mode="references"), "found")
    rows = codesearch.evidenced(found, queries, held["references"], "references", held["definitions"])
    return rows.select(
        "query_id", "id", "place", "route", F.col("edge.source").alias("source"), F.col("edge.target").alias("target"), F.size("witnesses").cast("long").alias("n_witnesses"), F.trim(F.col("witnesses")[0]["text"]).alias("witness"),
        F.size("definitions").cast("long").alias("n_definitions"), F.col("definitions")[0]["first_line"].alias("defined_at"), F.col("definitions")[0]["text"].alias("definition"),
    )


def lookups(spark, sf_dir):
    """Names looked up in the rendered graph: ids, display names, one with a kind that fits and one with one that does not."""
    # names meet the catalogue only: no source is read for them
    cat = codegraph.catalogue(tables.code_projection(spark, sf_dir)[0]).checkpoint()
    ask = lambda way, name, bare, kind: F.struct(F.lit(way).alias("way"), name.alias("name"), F.lit(bare).alias("bare"), F.lit(kind).cast("string").alias("kind"))
    asked = cat.select(F.explode(F.array(ask("id", F.col("id"), False, None), ask("name", F.col("name"), True, None), ask("class", F.col("name"), True, "class"), ask("module", F.col("name"), True, "module"), ask("none", F.concat("name", F.lit("x")), True, None))).alias("q"))
    queries = asked.select(F.concat_ws("/", "q.way", "q.name").alias("query_id"), "q.name", "q.bare", "q.kind").distinct()
    return codegraph.lookup(queries, cat).select("query_id", "id", "confidence")


def timed_points(spark, sf_dir):
    """Memories of users by week, every third one closing the latest open one of the same text: owner, session, pos, text, since, closes."""
    e = tables.table(spark, sf_dir, "events")
    text = F.concat("event_type", F.lit(" "), (F.floor("value").cast("long") % 3).cast("string"))
    session = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    return e.select(F.col("user_id").alias("owner"), session.alias("session"), F.struct("ts", "event_id").alias("pos"), text.alias("text"), F.col("ts").cast("timestamp").alias("since"), F.when(F.col("event_id") % 3 == 0, F.array(text)).otherwise(F.array().cast("array<string>")).alias("closes"))


def timed_questions(spark, sf_dir):
    """What each event asks whose number 20 divides, at the end of the day it names or else at its own time: evidence is its own memory."""
    e = tables.table(spark, sf_dir, "events").where(F.col("event_id") % 20 == 0)
    said = F.concat("event_type", F.lit(" "), (F.floor("value").cast("long") % 3).cast("string"))
    day = F.concat(F.lit(" by "), F.date_format("ts", "MMMM d, yyyy"))
    text = F.concat(F.lit("which "), said, F.when(F.col("event_id") % 40 == 0, day).otherwise(""))
    session = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    return e.select(F.col("event_id").alias("question_id"), F.col("user_id").alias("owner"), session.alias("session"), text.alias("text"), fx.question_time(text, F.col("ts").cast("timestamp")).alias("at"), F.array(said).alias("evidence"), F.col("event_type").alias("type"))


def memory_inputs(spark, sf_dir):
    points = factgraph.snapshot_links(timed_points(spark, sf_dir)).checkpoint()
    questions = timed_questions(spark, sf_dir).checkpoint()
    return points, questions, factgraph.memory_search(points, questions.select("question_id", "owner", "session", "text", "at"))


def memory_ranks(spark, sf_dir):
    """The best memories of each question's snapshot, and of the active ones."""
    _, _, found = memory_inputs(spark, sf_dir)
    return found.select("question_id", "arm", "rank", F.col("point.event_id").alias("event_id"), "stale")


def memory_summary(spark, sf_dir):
    """Hits, recall, wins, losses and stale slots by type of question."""
    points, questions, found = memory_inputs(spark, sf_dir)
    return factgraph.memory_report(factgraph.memory_metrics(found, points, questions), questions.select("question_id", "type"))


QUERIES = {f.__name__: f for f in (code_routes, projection_edges, projection_witnesses, code_evidence, lookups, structural_search, routed_evaluation, memory_ranks, memory_summary, edge_frequency, callers, callees, graph_degree, orphans, containment, contained_by, innermost_scope, call_targets, fact_endpoints, multi_hop_rank, update_linking, active_memory_topk)}

EDGE_SQL = """item AS (SELECT 'supplier-' || cast(l_suppkey AS varchar) AS src, 'part-' || cast(l_partkey AS varchar) AS dst, l_returnflag <> 'N' AS is_call, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem),
e AS (SELECT src, dst, count(*) AS freq, count(*) FILTER (is_call) AS calls, min(place) AS first FROM item GROUP BY ALL)"""
GEO_SQL = """w AS (SELECT regexp_replace(r_name, '[^A-Za-z0-9]', '_', 'g') AS r, regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g') AS n, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT 'geo/' || r || '#' AS parent, 'geo/' || r || '#' || n || '#' AS child, n_nationkey + 100 AS o FROM w UNION ALL
 SELECT 'geo/' || r || '#' || n || '#', 'geo/' || r || '#' || n || '#' || regexp_replace(c_name, '[^A-Za-z0-9]', '_', 'g') || '().', c_custkey + 1000 FROM customer JOIN w ON c_nationkey = n_nationkey)"""
NORM = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"
RELFACTS = "SELECT c_custkey + 1000 AS doc, c_name || ' is a citizen of ' || n_name || '.' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey, n_name || ' is located in the continent of ' || r_name || '.' FROM nation JOIN region ON n_regionkey = r_regionkey"
CHAIN = "SELECT cast(n_nationkey AS bigint) AS query_id, 'What is the continent of the citizens of ' || n_name AS text FROM nation"
ENDS = f"SELECT c_custkey + 1000 AS doc, {NORM.format('c_name')} AS subject, {NORM.format('n_name')} AS object FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey, {NORM.format('n_name')}, {NORM.format('r_name')} FROM nation JOIN region ON n_regionkey = r_regionkey"
FOLD = "round(list_reduce(list_prepend({'part': 0::double, 'qtf': 1::bigint}, list({'part': part, 'qtf': qtf} ORDER BY first)), lambda a, x: {'part': (a.part + x.part) * (1 + 0.05::double * least(x.qtf - 1, 2)), 'qtf': 1::bigint}).part, 6)"
SQL = {
    "edge_frequency": f"WITH {EDGE_SQL} SELECT src, dst, freq, calls FROM e",
    "callers": f"WITH {EDGE_SQL} SELECT dst AS target, src AS id, cast(row_number() OVER (PARTITION BY dst ORDER BY first, src) AS integer) AS place FROM e WHERE calls > 0",
    "callees": f"WITH {EDGE_SQL} SELECT src AS target, dst AS id, cast(row_number() OVER (PARTITION BY src ORDER BY first, dst) AS integer) AS place FROM e WHERE calls > 0",
    "graph_degree": f"WITH {EDGE_SQL} SELECT src AS id, count(DISTINCT dst) AS degree FROM e GROUP BY ALL UNION ALL SELECT dst, count(DISTINCT src) FROM e GROUP BY ALL",
    "orphans": f"WITH {EDGE_SQL} SELECT 'part-' || cast(p_partkey AS varchar) AS id FROM part WHERE 'part-' || cast(p_partkey AS varchar) NOT IN (SELECT dst FROM e WHERE calls > 0)",
    "containment": f"WITH {GEO_SQL} SELECT parent, child FROM k",
    "contained_by": f"WITH {GEO_SQL} SELECT parent AS target, child AS id, cast(row_number() OVER (PARTITION BY parent ORDER BY NOT child LIKE '%().', o) AS integer) AS place FROM k",
    "innermost_scope": """WITH s AS (SELECT i, i * 2 AS l0, CASE WHEN i % 2 = 0 THEN i * 2 + 4 ELSE i * 2 + 1 END AS l1 FROM range(8) t(i)), p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 8 AS c FROM lineitem),
m AS (SELECT p.*, i, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l1 - l0, 5, i) AS n FROM p JOIN s ON (l_linenumber > l0 OR (l_linenumber = l0 AND c >= 0)) AND (l_linenumber < l1 OR (l_linenumber = l1 AND c < 5)))
SELECT cast(p.l_orderkey AS varchar) AS path, p.l_linenumber AS line, p.l_partkey AS part, p.l_suppkey AS supplier, coalesce('s' || cast(i AS varchar), 'file:' || cast(p.l_orderkey AS varchar)) AS scope FROM p LEFT JOIN m ON n = 1 AND p.l_orderkey = m.l_orderkey AND p.l_linenumber = m.l_linenumber AND p.l_partkey = m.l_partkey AND p.l_suppkey = m.l_suppkey""",
    "fact_endpoints": ENDS,
    "multi_hop_rank": f"""WITH RECURSIVE {parts_sql('b', TOKENS, 'double', CHAIN, RELFACTS)}, boosted AS (SELECT query_id, doc, {FOLD} AS score FROM b GROUP BY ALL), {ranked('boosted', 20, 'r')},
n AS (SELECT doc, subject AS node FROM ({ENDS}) UNION SELECT doc, object FROM ({ENDS})),
h AS (SELECT query_id, doc, 0 AS hop FROM r WHERE rank = 1 UNION SELECT query_id, b.doc, hop + 1 FROM h JOIN n a ON a.doc = h.doc JOIN n b ON b.node = a.node WHERE hop < 3),
hop AS (SELECT query_id, doc, min(hop) AS hop FROM h GROUP BY ALL), l AS (SELECT node, count(*) - 1 AS others FROM n GROUP BY ALL), g AS (SELECT doc, sum(others) AS degree FROM n JOIN l USING (node) GROUP BY ALL),
t AS (SELECT coalesce(r.query_id, hop.query_id) AS query_id, coalesce(r.doc, hop.doc) AS doc, r.rank AS direct, hop FROM r FULL JOIN hop ON r.query_id = hop.query_id AND r.doc = hop.doc),
s AS (SELECT query_id, t.doc, CASE WHEN direct <= 3 THEN direct END AS pin, round(coalesce(0.2::double / (60 + direct), 0) + coalesce(pow(0.82::double, hop) / (hop + 1), 0) + least(coalesce(degree, 0), 6) * 0.01::double, 9) AS score FROM t LEFT JOIN g ON g.doc = t.doc)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY pin NULLS LAST, score DESC, doc) AS integer) AS rank, doc FROM s QUALIFY rank <= 5""",
    "update_linking": """WITH p AS (SELECT user_id AS owner, event_id AS pos, event_type || ' ' || cast(cast(floor(value) AS bigint) % 3 AS varchar) AS key, ts AS since, event_id % 3 = 0 AS shuts FROM events),
b AS (SELECT owner, key, pos, 1 AS o, since, 1 AS step FROM p UNION ALL SELECT owner, key, pos, 0, since, -1 FROM p WHERE shuts),
s AS (SELECT *, sum(step) OVER w AS total FROM b WINDOW w AS (PARTITION BY owner, key ORDER BY pos, o)), d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY owner, key ORDER BY pos, o)) AS depth FROM s),
v AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY owner, key ORDER BY pos, o) AS before FROM d), l AS (SELECT *, CASE WHEN step = 1 THEN depth ELSE before END AS level FROM v WHERE step = 1 OR before > 0),
n AS (SELECT *, lead(step) OVER w AS ns, lead(since) OVER w AS nt FROM l WINDOW w AS (PARTITION BY owner, key, level ORDER BY pos, o))
SELECT owner, pos, since, CASE WHEN ns = -1 THEN nt END AS until FROM n WHERE step = 1""",
    "active_memory_topk": f"WITH {BOOST}, able AS (SELECT * FROM boosted WHERE doc % 30 <= query_id % 30 AND query_id % 30 < doc % 30 + 10), {ranked('able', 5, 'r')} SELECT * FROM r",
}

GRAPH_SQL = """
cu AS (SELECT c_custkey AS c, c_nationkey AS n, c_acctbal AS balance, 'geo/nation' || c_nationkey || '.py' AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS nth, (SELECT count(*) FROM customer) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey),
uses AS (SELECT c, path, nth, 1 AS part, c * 7 % total + 1 AS t FROM cu UNION ALL SELECT c, path, nth, 2, c * 11 % total + 1 FROM cu),
refs AS (SELECT uses.*, 'geo/customer' || c || '().' AS src, 'geo/customer' || t || '().' AS dst FROM uses WHERE t IN (SELECT c FROM cu)),
eg AS (SELECT src, dst, count(*) AS freq, count(*) FILTER (part = 1) AS calls, min((path, nth, part)) AS first FROM refs WHERE src <> dst GROUP BY ALL)"""
CODE = "list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda w: lower(w))"
ROUTE_DOCS = "SELECT p_partkey AS doc, 'part-' || p_partkey AS id, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part UNION ALL SELECT s_suppkey + 5368709120, 'supplier-' || s_suppkey, s_name FROM supplier"
ROUTE_QUERIES = f"SELECT id AS query_id, id || ' ' || text AS text FROM ({ROUTE_DOCS}) WHERE doc % 20 = 0"
MEMORY_SQL = """
p AS (SELECT user_id AS owner, event_id AS pos, ts, date_diff('day', date '2024-01-01', cast(ts AS date)) // 7 AS session, event_type || ' ' || cast(cast(floor(value) AS bigint) % 3 AS varchar) AS key, event_id % 3 = 0 AS shuts FROM events),
b0 AS (SELECT owner, key, pos, 1 AS o, ts, session, 1 AS step FROM p UNION ALL SELECT owner, key, pos, 0, ts, session, -1 FROM p WHERE shuts),
s0 AS (SELECT *, sum(step) OVER w AS total FROM b0 WINDOW w AS (PARTITION BY owner, key ORDER BY ts, pos, o)), d0 AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY owner, key ORDER BY ts, pos, o)) AS depth FROM s0),
v0 AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY owner, key ORDER BY ts, pos, o) AS before FROM d0), l0 AS (SELECT *, CASE WHEN step = 1 THEN depth ELSE before END AS level FROM v0 WHERE step = 1 OR before > 0),
n0 AS (SELECT *, lead(step) OVER w AS ns, lead(ts) OVER w AS nt, lead(session) OVER w AS nsession FROM l0 WINDOW w AS (PARTITION BY owner, key, level ORDER BY ts, pos, o)),
pts AS (SELECT owner, pos, ts AS since, session, key AS text, CASE WHEN ns = -1 THEN nt END AS until, CASE WHEN ns = -1 THEN nsession END AS until_session FROM n0 WHERE step = 1),
qs AS (SELECT event_id AS question_id, event_type AS type, user_id AS owner, date_diff('day', date '2024-01-01', cast(ts AS date)) // 7 AS session, event_type || ' ' || cast(cast(floor(value) AS bigint) % 3 AS varchar) AS said,
 'which ' || event_type || ' ' || cast(cast(floor(value) AS bigint) % 3 AS varchar) || CASE WHEN event_id % 40 = 0 THEN ' by ' || strftime(ts, '%B %-d, %Y') ELSE '' END AS text, CASE WHEN event_id % 40 = 0 THEN cast(ts AS date) + interval 1 day - interval 1 second ELSE ts END AS asked_at FROM events WHERE event_id % 20 = 0),
held AS (SELECT s.owner || '/' || s.session AS g, s.owner AS owner, s.session AS asked, pos AS doc, text, since, CASE WHEN until_session <= s.session THEN until END AS until FROM (SELECT DISTINCT owner, session FROM qs) s JOIN pts ON pts.owner = s.owner AND pts.session <= s.session),""" + grouped_parts_sql("mb", TOKENS, "SELECT question_id AS query_id, owner || '/' || session AS g, text FROM qs", "SELECT g, doc, text FROM held") + """,
msc AS (SELECT query_id, doc, """ + FOLD + """ AS score FROM mb GROUP BY ALL),
every AS (SELECT question_id, held.doc AS doc, since, coalesce(score, 0) AS score, NOT (since <= asked_at AND (until IS NULL OR asked_at < until)) AS stale, held.text AS text FROM qs JOIN held ON g = qs.owner || '/' || qs.session LEFT JOIN msc ON query_id = question_id AND msc.doc = held.doc),
found AS (SELECT question_id, 'flat' AS arm, cast(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, since, doc) AS integer) AS rank, doc, stale, text FROM every QUALIFY rank <= 5
 UNION ALL SELECT question_id, 'temporal', cast(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, since, doc) AS integer) AS rank, doc, stale, text FROM every WHERE NOT stale QUALIFY rank <= 5)"""
SQL |= {
    "call_targets": "SELECT cast(p_partkey AS varchar) AS path, 2::bigint AS n, CASE p_partkey % 3 WHEN 0 THEN 8 ELSE 20 END AS first_column, CASE p_partkey % 3 WHEN 0 THEN greatest(13 + length(cast(p_size AS varchar)), 18) ELSE 27 END AS last_column FROM part WHERE p_partkey % 3 < 2",
    "projection_edges": f"WITH {GRAPH_SQL} SELECT src, dst, freq, calls, first[3] AS first_part FROM eg",
    "projection_witnesses": f"WITH {GRAPH_SQL} SELECT src, dst, path, cast(nth * 5 + 1 + part AS integer) AS first_line, cast(nth * 5 + 1 + part AS integer) AS last_line, CASE part WHEN 1 THEN 'y = customer' || t || '(x)' ELSE 'z = customer' || t END AS text, part = 1 AS is_call, true AS available FROM refs",
    "structural_search": f"""WITH {GRAPH_SQL}, fn AS (SELECT 'geo/customer' || c || '().' AS id, path, c FROM cu), near AS (SELECT src AS id, dst AS x FROM eg UNION SELECT dst, src FROM eg), deg AS (SELECT id, count(*) AS degree FROM near GROUP BY ALL), st AS (SELECT 'geo/nation' || n_nationkey || '#' AS id, 'geo/nation' || n_nationkey || '.py' AS path, n_nationkey AS n FROM nation),
 own AS (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY o) AS place FROM (SELECT path, id, c + 1000 AS o FROM fn UNION ALL SELECT path, id, n FROM st)),
 r AS (SELECT 'implementors' AS operation, 'geo/nation' || n || '#' AS target, 'geo/customer' || c || '().' AS id, row_number() OVER (PARTITION BY n ORDER BY c) AS place, 'implementation' AS route, 1.0::double AS confidence FROM cu WHERE balance > 0
 UNION ALL SELECT 'file_symbols', path, id, place, 'file_scope', 1.0 FROM own UNION ALL SELECT 'callers', 'file:' || path, id, place, 'calls_incoming', 0.95 FROM own
 UNION ALL SELECT 'orphans', 'function', fn.id, row_number() OVER (ORDER BY coalesce(degree, 0) DESC, c), 'orphan_scan', 0.9 FROM fn LEFT JOIN deg ON deg.id = fn.id WHERE fn.id NOT IN (SELECT dst FROM eg WHERE calls > 0)
 UNION ALL SELECT 'callers', dst, src, row_number() OVER (PARTITION BY dst ORDER BY first, src), 'calls_incoming', 0.95 FROM eg WHERE calls > 0 UNION ALL SELECT 'callees', src, dst, row_number() OVER (PARTITION BY src ORDER BY first, dst), 'calls_outgoing', 0.95 FROM eg WHERE calls > 0)
 SELECT operation || '/' || target AS query_id, operation, id, cast(place AS integer) AS place, route, confidence FROM r WHERE place <= 512""",
    "code_evidence": f"""WITH {GRAPH_SQL}, pr AS (SELECT src, dst, count(*) AS n_witnesses, arg_min(CASE part WHEN 1 THEN 'y = customer' || t || '(x)' ELSE 'z = customer' || t END, (path, nth * 5 + 1 + part)) AS witness FROM refs GROUP BY ALL),
 cand AS (SELECT 'callers/' || dst AS query_id, src AS id, src, dst, 'references_incoming' AS route, cast(row_number() OVER (PARTITION BY dst ORDER BY first, src) AS integer) AS place FROM eg UNION ALL SELECT 'callees/' || src, dst, src, dst, 'references_outgoing', cast(row_number() OVER (PARTITION BY src ORDER BY first, dst) AS integer) FROM eg)
 SELECT query_id, id, place, route, cand.src AS source, cand.dst AS target, n_witnesses, witness, 1::bigint AS n_definitions, cast(nth * 5 + 1 AS integer) AS defined_at, 'def customer' || c || '(x):' AS definition
 FROM cand JOIN pr ON pr.src = cand.src AND pr.dst = cand.dst JOIN cu ON cand.id = 'geo/customer' || c || '().' WHERE place <= 512""",
    "lookups": f"""WITH {GRAPH_SQL}, cat AS (SELECT 'geo/customer' || c || '().' AS id, 'customer' || c AS name, false AS struct FROM cu UNION ALL SELECT 'geo/nation' || n_nationkey || '#', 'nation' || n_nationkey, true FROM nation)
 SELECT 'id/' || id AS query_id, id, 1.0::double AS confidence FROM cat UNION ALL SELECT 'name/' || name, id, 0.98::double FROM cat UNION ALL SELECT 'class/' || name, id, 0.98::double FROM cat WHERE struct""",
    "code_routes": f"""WITH {EDGE_SQL}, docs AS ({ROUTE_DOCS}), rq AS ({ROUTE_QUERIES}), deg AS (SELECT src AS id, count(DISTINCT dst) AS degree FROM e GROUP BY ALL UNION ALL SELECT dst, count(DISTINCT src) FROM e GROUP BY ALL),
 {parts_sql('f', CODE, 'float', 'SELECT * FROM rq', 'SELECT doc, text FROM docs')}, fs AS (SELECT query_id, doc, list_reduce(list_prepend(0::float, list(cast(part * qtf::float AS float) ORDER BY first)), lambda a, x: cast(a + x AS float)) AS score FROM f GROUP BY ALL),
 fo AS (SELECT dst AS query_id, src AS id, row_number() OVER (PARTITION BY dst ORDER BY first, src) AS place, freq FROM e WHERE calls > 0 AND dst IN (SELECT query_id FROM rq) QUALIFY place <= 512),
 v AS (SELECT fo.query_id, fo.id, docs.doc, place, freq, coalesce(fs.score, 0)::double AS lexical, coalesce(degree, 0) AS degree FROM fo JOIN docs ON docs.id = fo.id LEFT JOIN fs ON fs.query_id = fo.query_id AND fs.doc = docs.doc LEFT JOIN deg ON deg.id = fo.id),
 c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, doc) AS c1, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc) AS c2, row_number() OVER (PARTITION BY query_id ORDER BY freq DESC, doc) AS c3, row_number() OVER (PARTITION BY query_id ORDER BY degree DESC, doc) AS c4 FROM v),
 w AS (SELECT rq.query_id, docs.id, docs.doc, row_number() OVER (PARTITION BY rq.query_id ORDER BY coalesce(fs.score, 0) DESC, docs.doc) AS r FROM rq CROSS JOIN docs LEFT JOIN fs ON fs.query_id = rq.query_id AND fs.doc = docs.doc WHERE rq.query_id NOT IN (SELECT query_id FROM fo) QUALIFY r <= 200),
 t AS (SELECT query_id, id, doc, 'calls_incoming' AS route, round(1::double / (60 + c1) + 1::double / (60 + c2) + 1::double / (60 + c3) + 4::double / (60 + c4), 9) AS score FROM c UNION ALL SELECT query_id, id, doc, 'bm25_fallback', round(1::double / (60 + r), 9) FROM w)
 SELECT query_id, id, cast(row_number() OVER (PARTITION BY query_id ORDER BY t.score DESC, doc) AS integer) AS rank, route, round(score, 6) AS score FROM t QUALIFY rank <= 5""",
    "routed_evaluation": f"""WITH q AS (SELECT cast(n_nationkey AS bigint) AS query_id, 'chain' AS source, 'What is the continent of the citizens of ' || n_name AS text, r_name AS answer FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey + 100, 'plain', 'Where is ' || n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
 facts AS ({RELFACTS}), {parts_sql('b', TOKENS, 'double', 'SELECT query_id, text FROM q', RELFACTS)}, boosted AS (SELECT query_id, doc, {FOLD} AS score FROM b GROUP BY ALL),
 w AS (SELECT q.query_id, facts.doc FROM q CROSS JOIN facts LEFT JOIN boosted ON boosted.query_id = q.query_id AND boosted.doc = facts.doc QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(score, 0) DESC, facts.doc) <= 5),
 f AS (SELECT 'words' AS profile, * FROM w UNION ALL SELECT 'graph', query_id, doc FROM ({SQL['multi_hop_rank']}) UNION ALL SELECT 'graph', * FROM w WHERE query_id >= 100),
 h AS (SELECT source, q.query_id, bool_or(contains({NORM.format('facts.text')}, {NORM.format('answer')})) FILTER (profile = 'words') AS words, bool_or(contains({NORM.format('facts.text')}, {NORM.format('answer')})) FILTER (profile = 'graph') AS graph FROM f JOIN q USING (query_id) JOIN facts USING (doc) GROUP BY ALL)
 SELECT source, count(*) AS n, count(*) FILTER (query_id < 100) AS n_routed, count(*) FILTER (words) AS words_hits, count(*) FILTER (graph) AS graph_hits, count(*) FILTER (graph AND NOT words) AS wins, count(*) FILTER (words AND NOT graph) AS losses, count(*) FILTER (words = graph) AS ties FROM h GROUP BY GROUPING SETS ((source), ())""",
    "memory_ranks": f"WITH {MEMORY_SQL} SELECT question_id, arm, rank, doc AS event_id, stale FROM found",
    "memory_summary": f"""WITH {MEMORY_SQL}, m AS (SELECT qs.question_id, type, coalesce(bool_or(f.text = said) FILTER (arm = 'flat'), false) AS fh, coalesce(bool_or(f.text = said) FILTER (arm = 'temporal'), false) AS th, count(*) FILTER (arm = 'flat' AND stale) AS fs, count(*) FILTER (arm = 'temporal' AND stale) AS tst FROM qs LEFT JOIN found f USING (question_id) GROUP BY ALL)
 SELECT type, count(*) AS n, round(avg(fh::double), 6) AS flat_hit5, round(avg(th::double), 6) AS temporal_hit5, round(avg(fh::double), 6) AS flat_recall5, round(avg(th::double), 6) AS temporal_recall5, count(*) FILTER (th AND NOT fh) AS wins, count(*) FILTER (fh AND NOT th) AS losses, cast(sum(fs) AS bigint) AS flat_stale_slots, cast(sum(tst) AS bigint) AS temporal_stale_slots FROM m GROUP BY GROUPING SETS ((type), ())""",
}
