"""The given tables, and the operators' inputs that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import session
from factloom.functions import text as fx
from factloom.operators import journal
from factloom.operators.factgraph import TEMPLATES

#: Event types as predicates.
PREDICATES = {"signup": "exists", "purchase": "default", "click": "parameter_exists", "error": "signature", "view": "calls"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about users: one assertion for each event."""
    predicate = F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv])
    start = F.when(F.col("event_id") % 23 != 0, F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long"))
    span = F.col("event_id") % 7
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity"), predicate[F.col("event_type")].alias("predicate"),
        (F.floor("value").cast("long") % 5).cast("string").alias("value_json"), F.lit("events").alias("repository"), F.lit("main").alias("branch"),
        F.concat(F.lit("env-"), (F.col("event_id") % 2).cast("string")).alias("environment"), start.alias("valid_from"), F.when(span != 0, start + span).alias("valid_to"),
        F.col("ts").cast("timestamp").alias("recorded_at"), F.to_json(F.struct(F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("source"))).alias("evidence_json"),
        (F.col("event_id") % 11 == 0).alias("negated"), F.col("event_id").alias("id"),
    )


def proposed_replacements(facts: DataFrame) -> DataFrame:
    """Each fact and the next one about the same entity, predicate and environment, as a proposal to replace."""
    w = Window.partitionBy("entity", "predicate", "environment").orderBy("recorded_at", "id")
    nxt = facts.repartition(journal.shares(facts), "entity", "predicate", "environment").withColumn("new_id", F.lead("id").over(w)).withColumn("effective", F.lead("valid_from").over(w)).withColumn("at", F.lead("recorded_at").over(w))
    return nxt.where("new_id IS NOT NULL").select(F.col("id").alias("old_id"), "new_id", "effective", F.col("at").alias("recorded_at"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue turns in plain characters, ten sessions to a conversation, with rendered names, dates and questions.

    conversation_id, session, pos, dia_id, speaker, text, session_date
    """
    kept = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("conv_id") % 365).cast("int"))
    speaker = F.when(F.col("role") == "user", "Anna").otherwise("Ben")
    tail = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit(" I met Ben on "), F.date_format(day, "d MMMM yyyy"), F.lit(".")))
        .when(F.col("turn") % 5 == 1, F.lit(" You said that Anna will travel next month. Did you read it?"))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit(" Anna moved in "), F.date_format(day, "MMMM yyyy"), F.lit(". It was good.")))
        .when(F.col("turn") % 5 == 3, F.lit(" Ben saw them yesterday."))
        .otherwise(F.lit(" Where did Ben go?"))
    )
    session = (F.col("conv_id") % 10 + 1).cast("int")
    return kept.select(
        F.floor(F.col("conv_id") / 10).cast("long").alias("conversation_id"), session.alias("session"), (F.col("turn") + 1).cast("int").alias("pos"),
        F.concat(F.lit("D"), session.cast("string"), F.lit(":"), (F.col("turn") + 1).cast("string")).alias("dia_id"), speaker.alias("speaker"),
        F.concat(plain, tail).alias("text"), day.alias("session_date"),
    )


#: The same turns in DuckDB's SQL.
TURNS_SQL = """
turns AS (
 SELECT conv_id // 10 AS conversation_id, cast(conv_id % 10 + 1 AS integer) AS session, cast(turn + 1 AS integer) AS pos,
  'D' || cast(conv_id % 10 + 1 AS varchar) || ':' || cast(turn + 1 AS varchar) AS dia_id,
  CASE WHEN role = 'user' THEN 'Anna' ELSE 'Ben' END AS speaker,
  regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') || CASE
   WHEN turn % 5 = 0 THEN ' I met Ben on ' || strftime(date '2023-01-01' + cast(conv_id % 365 AS integer), '%-d %B %Y') || '.'
   WHEN turn % 5 = 1 THEN ' You said that Anna will travel next month. Did you read it?'
   WHEN turn % 5 = 2 THEN ' Anna moved in ' || strftime(date '2023-01-01' + cast(conv_id % 365 AS integer), '%B %Y') || '. It was good.'
   WHEN turn % 5 = 3 THEN ' Ben saw them yesterday.'
   ELSE ' Where did Ben go?' END AS text,
  date '2023-01-01' + cast(conv_id % 365 AS integer) AS session_date
 FROM conversations WHERE role IN ('user', 'assistant'))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for each turn, of all its words of letters: question_id, conversation_id, question."""
    t = turns(spark, sf_dir)
    some = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0), " ")
    head = F.when(F.col("pos") % 3 == 0, "When did Anna meet ").when(F.col("pos") % 3 == 1, "What did Ben say about ").otherwise(F.concat(F.lit("In "), F.date_format("session_date", "MMMM yyyy"), F.lit(" what was ")))
    return t.select(F.concat_ws("/", F.col("conversation_id").cast("string"), "dia_id").alias("question_id"), "conversation_id", F.concat(head, some, F.lit("?")).alias("question"))


QUESTIONS_SQL = """
questions AS (
 SELECT cast(conversation_id AS varchar) || '/' || dia_id AS question_id, conversation_id,
  CASE WHEN pos % 3 = 0 THEN 'When did Anna meet ' WHEN pos % 3 = 1 THEN 'What did Ben say about ' ELSE 'In ' || strftime(session_date, '%B %Y') || ' what was ' END
  || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') || '?' AS question
 FROM turns)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def corpus_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a query: query_id, text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def relational_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences about customers and nations: doc, text."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    a = people.select((F.col("c_custkey") + 1000).alias("doc"), F.concat("c_name", F.lit(" is a citizen of "), "n_name", F.lit(".")).alias("text"))
    b = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("doc"), F.concat("n_name", F.lit(" is located in the continent of "), "r_name", F.lit(".")).alias("text"))
    return a.unionByName(b)


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers refer to parts: src, dst, is_call and the place of each line item."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("dst"), (F.col("l_returnflag") != "N").alias("is_call"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("place"))


def template_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence about each customer and nation, the customers taking the templates in turn: doc, text."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    plain = [t.replace("(?:state in|the)", "the") for t in TEMPLATES]
    chosen = F.element_at(fx.strings(plain), (F.col("c_custkey") % len(plain) + 1).cast("int"))
    said = F.replace(F.replace(chosen, F.lit("<s>"), F.col("c_name")), F.lit("<o>"), F.col("n_name"))
    a = people.select((F.col("c_custkey") + 1000).alias("doc"), F.concat(said, F.when(F.col("c_custkey") % 2 == 0, ".").otherwise("")).alias("text"))
    b = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("doc"), F.concat("n_name", F.lit(" is located in the continent of "), "r_name", F.lit(".")).alias("text"))
    return a.unionByName(b)


#: Lines that each customer's function takes in its nation's source.
LINES = 5
#: Functions of a piece of a nation's source.
FUNCTIONS = 100


def code_projection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(symbols, relationships, occurrences, sources): a source for each nation, with a function for each of its customers, in pieces of some functions.

    A function calls the function of one customer and names another's; those with a balance implement their nation.
    """
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.concat(F.lit("geo/nation"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c"), F.col("c_nationkey").cast("long").alias("n"), F.col("c_acctbal").alias("balance"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("n").orderBy("c")) - 1)
    total = rows.agg(F.count("*").alias("total"))
    rows = rows.join(nation, "n").crossJoin(F.broadcast(total)).select("*", ((F.col("c") * 7) % F.col("total") + 1).alias("calls"), ((F.col("c") * 11) % F.col("total") + 1).alias("names"))
    rows = session.written(rows, "projection")
    symbol = lambda c: F.concat(F.lit("geo/customer"), F.col(c).cast("string"), F.lit("()."))
    first = F.col("nth") * LINES
    body = F.concat(F.lit("def customer"), F.col("c").cast("string"), F.lit("(x):\n    y = customer"), F.col("calls").cast("string"), F.lit("(x)\n    z = customer"), F.col("names").cast("string"), F.lit("\n    return y\n\n"))
    sources = rows.groupBy("path", F.floor(F.col("nth") / FUNCTIONS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", body.alias("body")))), lambda x: x["body"]), "").alias("text"))
    interface = F.concat(F.lit("geo/nation"), F.col("n").cast("string"), F.lit("#"))
    symbols = rows.select(symbol("c").alias("id"), (F.col("c") + 1000).alias("ord"), F.col("path").alias("source_path")).unionByName(nation.select(interface.alias("id"), F.col("n").alias("ord"), F.col("path").alias("source_path")))
    related = rows.select(symbol("c").alias("id"), interface.alias("target"), (F.col("balance") > 0).alias("is_implementation"))
    wide = lambda c: F.length(F.concat(F.lit("customer"), F.col(c).cast("string")))
    place = lambda line, start, size: F.array(first + line, F.lit(start), F.lit(start) + size).cast("array<int>")
    one = lambda number, name, defines, at, around: F.struct(F.struct(F.col("nth"), F.lit(number).alias("part")).alias("point"), name.alias("symbol"), F.lit(defines).alias("is_definition"), at.alias("range"), around.alias("enclosing"))
    none = F.lit(None).cast("array<int>")
    whole = F.array(first, F.lit(0), first + LINES - 1, F.lit(0)).cast("array<int>")
    found = F.array(one(0, symbol("c"), True, place(0, 4, wide("c")), whole), one(1, symbol("calls"), False, place(1, 8, wide("calls")), none), one(2, symbol("names"), False, place(2, 8, wide("names")), none))
    return symbols, related, rows.select("path", F.explode(found).alias("o")).select("path", "o.*"), sources


def question_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of questions(): category 1 to 5, raw evidence (the next turn and the third one on, some with leading zeros, empty or of no turn) and an answer.

    question_id, conversation_id, question, category, evidence, answer_text
    """
    t = turns(spark, sf_dir).select(F.concat_ws("/", F.col("conversation_id").cast("string"), "dia_id").alias("question_id"), "session", "pos", "session_date")
    zero = F.when(F.col("pos") % 3 == 1, "D0").otherwise("D")
    own = F.concat(zero, F.col("session").cast("string"), F.lit(":"), (F.col("pos") + 1).cast("string"), F.lit("; D"), F.col("session").cast("string"), F.lit(":"), (F.col("pos") + 3).cast("string"))
    evidence = F.when(F.col("pos") % 7 == 0, F.array().cast("array<string>")).when(F.col("pos") % 11 == 0, F.array(F.lit("D99:1"))).otherwise(F.array(own))
    said = F.when(F.col("pos") % 2 == 0, F.date_format("session_date", "d MMMM, yyyy")).otherwise("nobody knows")
    rows = t.select("question_id", (F.col("pos") % 5 + 1).cast("int").alias("category"), evidence.alias("evidence"), said.alias("answer_text"))
    return questions(spark, sf_dir).join(rows, "question_id")


LABELS_SQL = """
labels AS (SELECT question_id, cast(pos % 5 + 1 AS integer) AS category, pos, session,
  CASE WHEN pos % 7 = 0 THEN []::varchar[] WHEN pos % 11 = 0 THEN ['D99:1'] ELSE list_sort(['D' || session || ':' || (pos + 1), 'D' || session || ':' || (pos + 3)]) END AS gold,
  pos % 7 <> 0 AND pos % 11 <> 0 AND pos % 3 = 1 AS padded,
  CASE WHEN pos % 2 = 0 THEN session_date END AS said_day
 FROM (SELECT *, cast(conversation_id AS varchar) || '/' || dia_id AS question_id FROM turns))"""
