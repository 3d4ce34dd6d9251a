"""Queries over the assertion journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import journal, workspace
from factloom.sources import tables

AT, KNOWN = 15, "2024-01-20 00:00:00"


def coordinates(spark: SparkSession, places: list[tuple[int, int, str]]) -> DataFrame:
    rows = [(n, at, known, "events", "main", "env-0") for n, at, known in places]
    return spark.createDataFrame(rows, "coordinate int, at long, known string, repository string, branch string, environment string").withColumn("known", F.to_timestamp("known"))


def inputs(spark, sf_dir, places=((0, AT, KNOWN),)):
    facts = tables.assertions(spark, sf_dir)
    replaced = journal.replacements(tables.proposed_replacements(facts), facts)
    here = coordinates(spark, list(places))
    return facts, replaced, here, journal.derived(facts, replaced, here)


def recall(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, _, _, rows = inputs(spark, sf_dir)
        return journal.selected(rows, mode).select("id", "entity", "predicate", "value_json", "negated", "valid_from", "effective_to", F.size("superseded_by").cast("long").alias("n_superseding"), "status")

    return query


def recall_known_then_vs_now(spark, sf_dir):
    _, _, _, rows = inputs(spark, sf_dir, [(0, AT, "2024-01-10 00:00:00"), (1, AT, "2024-01-31 00:00:00")])
    then = F.max(F.when(F.col("coordinate") == 0, F.col("status"))).alias("then_status")
    now = F.max(F.when(F.col("coordinate") == 1, F.col("status"))).alias("now_status")
    return rows.groupBy("id").agg(then, now).groupBy("then_status", "now_status").agg(F.count("*").alias("n"))


def situation_matrix(spark, sf_dir):
    """Answers of all modes at six coordinates."""
    places = [(3 * i + j, at, known) for i, at in enumerate((5, 25)) for j, known in enumerate(("2023-12-31 00:00:00", "2024-01-15 00:00:00", "2024-01-31 00:00:00"))]
    _, _, here, rows = inputs(spark, sf_dir, places)
    return journal.answers(rows, here, *journal.MODES)


def effective_intervals(spark, sf_dir):
    _, _, _, rows = inputs(spark, sf_dir)
    return rows.select("id", "valid_from", "valid_to", "effective_to")


def conflict_pairs(spark, sf_dir):
    _, _, _, rows = inputs(spark, sf_dir)
    return journal.pairs(rows, "combined").where("diagnosis = 'conflict'").select("left_id", "right_id", "current")


def pair_diagnosis_histogram(spark, sf_dir):
    _, _, _, rows = inputs(spark, sf_dir)
    return journal.pairs(rows, "combined").groupBy("diagnosis").agg(F.count("*").alias("n"), F.count_if("current").alias("n_current"))


def assertion_ids(spark, sf_dir):
    facts = tables.assertions(spark, sf_dir)
    return journal.identified(facts.withColumn("event_id", F.col("event_id"))).select("event_id", "id")


def journal_dedup(spark, sf_dir):
    """A batch that holds every third known fact again, and each of its rows twice: what is new."""
    facts = tables.assertions(spark, sf_dir)
    known = journal.identified(facts.where("event_id % 3 = 0"))
    return journal.fresh(facts.unionByName(facts), known).select("event_id", "id")


def supersede_validation(spark, sf_dir):
    facts = tables.assertions(spark, sf_dir)
    return journal.refusals(tables.proposed_replacements(facts), facts).groupBy(F.coalesce("refusal", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def replacement_reachability(spark, sf_dir):
    """How many facts the replacements of each replaced fact lead to, along chains of any length."""
    facts = tables.assertions(spark, sf_dir)
    replaced = journal.replacements(tables.proposed_replacements(facts), facts)
    return journal.followed(replaced)


def refused_cycles(spark, sf_dir):
    """A batch that says of each fact that an earlier one about the same subject replaces it, beside the journal's replacements: what becomes of each."""
    facts = tables.assertions(spark, sf_dir)
    w = Window.partitionBy("entity", "predicate", *journal.SCOPE).orderBy("recorded_at", "id")
    earlier = lambda c: F.when(F.col("id") % 3 == 0, F.lag(c, 2).over(w)).otherwise(F.lag(c, 1).over(w))
    back = facts.select(F.col("id").alias("old_id"), earlier("id").alias("new_id"), F.greatest("valid_from", earlier("valid_from")).alias("effective"), "recorded_at").where("new_id IS NOT NULL")
    held = journal.replacements(tables.proposed_replacements(facts), facts)
    return journal.judged(back, facts, held).select("old_id", "new_id", F.coalesce("refusal", F.lit("accepted")).alias("outcome"))


def event_timeline(spark, sf_dir):
    """Every event of the journal with its place in its scope's history."""
    facts = tables.assertions(spark, sf_dir)
    replaced = journal.replacements(tables.proposed_replacements(facts), facts)
    events = journal.timeline(facts, replaced.withColumn("id", F.concat(F.lit("after-"), F.col("old_id").cast("string"))))
    return events.select("environment", "kind", "ref", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), "place")


def workspace_trace(spark, sf_dir):
    facts, replaced, here, _ = inputs(spark, sf_dir)
    return workspace.trace(facts, replaced, here, entity="user-7", predicate="exists").select("id", "reason")


def workspace_snapshots(spark, sf_dir):
    """A request for every event whose id 20 divides: how the event's subject stands at some position after some part of its environment's history."""
    facts = tables.assertions(spark, sf_dir)
    replaced = journal.replacements(tables.proposed_replacements(facts), facts).withColumn("id", F.concat(F.lit("after-"), F.col("old_id").cast("string")))
    asked = facts.where("event_id % 20 = 0").select(
        F.col("event_id").alias("coordinate"), *journal.SCOPE, (F.col("event_id") % 31).alias("at"), F.floor(F.col("event_id") / 2).alias("position"),
        F.to_timestamp(F.lit("2023-12-31 00:00:00")).alias("created"), "entity", "predicate",
    )
    return workspace.snapshots(facts, replaced, asked).withColumn("known", F.col("known").cast("timestamp_ntz"))


def seeded_recall(spark, sf_dir):
    """Controlled cases made of all parts: what is known of each at two positions and three times."""
    cases = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("entity"), F.col("p_size").cast("string").alias("original"), (F.col("p_size") + 1).cast("string").alias("changed"), F.lit("part.csv").alias("source"), F.col("p_name").alias("text"))
    facts, proposals = workspace.seeded(cases)
    facts = facts.checkpoint()
    replaced = journal.replacements(proposals.checkpoint(), facts)
    rows = journal.derived(facts, replaced, workspace.knowledge_coordinates(spark, [0, 1]))
    return rows.select("case_id", "kind", "coordinate", "status")


FACTS_SQL = """
facts AS (
 SELECT event_id AS id, 'user-' || cast(user_id AS varchar) AS entity,
  CASE event_type WHEN 'signup' THEN 'exists' WHEN 'purchase' THEN 'default' WHEN 'click' THEN 'parameter_exists' WHEN 'error' THEN 'signature' WHEN 'view' THEN 'calls' END AS predicate,
  cast(cast(floor(value) AS bigint) % 5 AS varchar) AS value_json, 'env-' || cast(event_id % 2 AS varchar) AS environment,
  CASE WHEN event_id % 23 <> 0 THEN cast(date_diff('day', date '2024-01-01', cast(ts AS date)) AS bigint) END AS valid_from,
  CASE WHEN event_id % 23 <> 0 AND event_id % 7 <> 0 THEN cast(date_diff('day', date '2024-01-01', cast(ts AS date)) AS bigint) + event_id % 7 END AS valid_to,
  ts AS recorded_at, event_id % 11 = 0 AS negated FROM events),
led AS (SELECT *, lead(id) OVER w AS new_id, lead(value_json) OVER w AS new_value, lead(valid_from) OVER w AS effective, lead(recorded_at) OVER w AS replaced_at, lead(valid_to) OVER w AS new_to
 FROM facts WINDOW w AS (PARTITION BY entity, predicate, environment ORDER BY recorded_at, id)),
judged AS (SELECT *, CASE WHEN effective IS NULL THEN 'effective'
  WHEN predicate = 'calls' AND value_json <> new_value THEN 'other value'
  WHEN valid_from IS NULL OR valid_from > effective THEN 'not yet valid'
  WHEN effective >= valid_to OR effective >= new_to THEN 'already over' END AS refusal FROM led WHERE new_id IS NOT NULL),
replaced AS (SELECT id AS old_id, new_id, effective, replaced_at FROM judged WHERE refusal IS NULL)"""


def recall_sql(places, coordinates: str | None = None) -> str:
    """The CTE rows: facts known at each coordinate with their status. coordinates: the CTE c in place of stated places."""
    values = ", ".join(f"({n}, {at}, timestamp '{known}')" for n, at, known in places)
    return f"""{FACTS_SQL},
{coordinates or f"c(coordinate, pos, known) AS (VALUES {values})"},
ends AS (SELECT coordinate, old_id, min(effective) AS f, count(*) FILTER (effective <= pos) AS n FROM replaced, c WHERE replaced_at <= known GROUP BY ALL),
derived AS (SELECT c.*, facts.*, coalesce(ends.n, 0) AS n_superseding, least(valid_to, ends.f) AS effective_to FROM facts JOIN c ON recorded_at <= known LEFT JOIN ends ON ends.coordinate = c.coordinate AND old_id = id WHERE environment = 'env-0'),
shown AS (SELECT *, CASE WHEN valid_from IS NULL THEN 'unknown_validity' WHEN pos < valid_from THEN 'not_yet_valid'
  WHEN pos >= effective_to THEN CASE WHEN n_superseding > 0 THEN 'superseded' ELSE 'expired' END ELSE 'active' END AS status FROM derived),
met AS (SELECT a.coordinate, a.id AS left_id, b.id AS right_id, a.status = 'active' AND b.status = 'active' AS current,
  CASE WHEN a.valid_from IS NULL OR b.valid_from IS NULL THEN 'unknown_validity'
   WHEN greatest(a.valid_from, b.valid_from) >= least(coalesce(a.effective_to, 1152921504606846976), coalesce(b.effective_to, 1152921504606846976)) THEN 'version_change' ELSE 'conflict' END AS diagnosis
 FROM shown a JOIN shown b ON a.coordinate = b.coordinate AND a.entity = b.entity AND a.predicate = b.predicate AND a.id < b.id
 WHERE CASE WHEN a.negated <> b.negated THEN a.value_json = b.value_json ELSE NOT a.negated AND a.predicate <> 'calls' AND a.value_json <> b.value_json END)"""


ONE = recall_sql([(0, AT, KNOWN)])
CANONICAL_SQL = """sha256('{"entity":"' || entity || '","evidence":{"source":"event-' || cast(id AS varchar) || '"},"negated":' || CASE WHEN negated THEN 'true' ELSE 'false' END
 || ',"predicate":"' || predicate || '","recorded_at":"' || strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","scope":{"branch":"main","environment":"' || environment
 || '","repository":"events"},"valid_from":' || coalesce(cast(valid_from AS varchar), 'null') || ',"valid_to":' || coalesce(cast(valid_to AS varchar), 'null') || ',"value":' || value_json || '}')"""


def mode_sql(mode: str) -> str:
    only = "WHERE status = 'active'" if mode in ("temporal", "combined") else ""
    return f"WITH {ONE} SELECT id, entity, predicate, value_json, negated, valid_from, effective_to, n_superseding, status FROM shown {only}"


PLACES = [(3 * i + j, pos, known) for i, pos in enumerate((5, 25)) for j, known in enumerate(("2023-12-31 00:00:00", "2024-01-15 00:00:00", "2024-01-31 00:00:00"))]


def matrix_sql() -> str:
    parts = []
    for mode in journal.MODES:
        only = "status = 'active'" if mode in ("temporal", "combined") else "true"
        bad = {"conflict": "(SELECT count(*) FROM bare WHERE bare.coordinate = c.coordinate)", "combined": "(SELECT count(*) FROM met WHERE met.coordinate = c.coordinate AND diagnosis = 'conflict' AND current)"}.get(mode, "0")
        parts.append(f"SELECT coordinate, '{mode}' AS mode, (SELECT count(*) FROM shown WHERE shown.coordinate = c.coordinate AND {only}) AS n_selected, cast({bad} AS bigint) AS n_conflicts FROM c")
    return f"""WITH {recall_sql(PLACES)}, bare AS (SELECT coordinate FROM met), m AS ({' UNION ALL '.join(parts)})
SELECT *, CASE WHEN n_conflicts > 0 THEN 'conflict' WHEN n_selected > 0 THEN 'supported' ELSE 'unknown' END AS answer FROM m"""


QUERIES = {f"recall_{m}": recall(m) for m in journal.MODES} | {
    f.__name__: f
    for f in (recall_known_then_vs_now, situation_matrix, effective_intervals, conflict_pairs, pair_diagnosis_histogram, assertion_ids, journal_dedup, supersede_validation, replacement_reachability, refused_cycles, event_timeline, workspace_trace, workspace_snapshots, seeded_recall)
}
SQL = {f"recall_{m}": mode_sql(m) for m in journal.MODES} | {
    "recall_known_then_vs_now": f"WITH {recall_sql([(0, AT, '2024-01-10 00:00:00'), (1, AT, '2024-01-31 00:00:00')])}, p AS (SELECT id, max(status) FILTER (coordinate = 0) AS then_status, max(status) FILTER (coordinate = 1) AS now_status FROM shown GROUP BY id) SELECT then_status, now_status, count(*) AS n FROM p GROUP BY ALL",
    "situation_matrix": matrix_sql(),
    "effective_intervals": f"WITH {ONE} SELECT id, valid_from, valid_to, effective_to FROM shown",
    "conflict_pairs": f"WITH {ONE} SELECT left_id, right_id, current FROM met WHERE diagnosis = 'conflict'",
    "pair_diagnosis_histogram": f"WITH {ONE} SELECT diagnosis, count(*) AS n, count(*) FILTER (current) AS n_current FROM met GROUP BY ALL",
    "assertion_ids": f"WITH {FACTS_SQL} SELECT id AS event_id, {CANONICAL_SQL} AS id FROM facts",
    "journal_dedup": f"WITH {FACTS_SQL} SELECT id AS event_id, {CANONICAL_SQL} AS id FROM facts WHERE facts.id % 3 <> 0",
    "supersede_validation": f"WITH {FACTS_SQL} SELECT coalesce(refusal, 'accepted') AS outcome, count(*) AS n FROM judged GROUP BY ALL",
    "replacement_reachability": f"WITH RECURSIVE {FACTS_SQL}, e AS (SELECT r.old_id, r.new_id FROM replaced r JOIN facts ON id = old_id), r AS (SELECT old_id AS source, new_id AS node FROM e UNION SELECT source, new_id FROM r JOIN e ON node = old_id) SELECT source, count(*) AS n_after, max(node) AS last_node FROM r GROUP BY ALL",
    "refused_cycles": f"""WITH RECURSIVE {FACTS_SQL}, o AS (SELECT *, CASE WHEN id % 3 = 0 THEN lag(id, 2) OVER w ELSE lag(id, 1) OVER w END AS new_id FROM facts WINDOW w AS (PARTITION BY entity, predicate, environment ORDER BY recorded_at, id)),
 b AS (SELECT o.id AS old_id, o.new_id, CASE WHEN greatest(o.valid_from, n.valid_from) IS NULL THEN 'effective' WHEN o.predicate = 'calls' AND o.value_json <> n.value_json THEN 'other value' WHEN o.valid_from IS NULL OR n.valid_from IS NULL THEN 'not yet valid'
  WHEN greatest(o.valid_from, n.valid_from) >= o.valid_to OR greatest(o.valid_from, n.valid_from) >= n.valid_to THEN 'already over' END AS refusal FROM o JOIN facts n ON n.id = o.new_id),
 e AS (SELECT old_id, new_id FROM replaced UNION SELECT old_id, new_id FROM b WHERE refusal IS NULL), r AS (SELECT new_id AS source, new_id AS node FROM b WHERE refusal IS NULL UNION SELECT source, e.new_id FROM r JOIN e ON node = e.old_id)
 SELECT old_id, new_id, coalesce(refusal, CASE WHEN EXISTS (SELECT 1 FROM r WHERE source = b.new_id AND node = b.old_id) THEN 'cycle' ELSE 'accepted' END) AS outcome FROM b""",
    "event_timeline": f"""WITH {FACTS_SQL}, ev AS (SELECT environment, 'assertion' AS kind, cast(id AS varchar) AS ref, recorded_at FROM facts UNION ALL SELECT environment, 'replacement', 'after-' || cast(old_id AS varchar), replaced_at FROM replaced JOIN facts ON id = old_id)
SELECT *, row_number() OVER (PARTITION BY environment ORDER BY recorded_at, ref) AS place FROM ev""",
    "workspace_snapshots": f"""WITH {FACTS_SQL},
 tl AS (SELECT environment, recorded_at, row_number() OVER (PARTITION BY environment ORDER BY recorded_at, ref) AS place FROM (SELECT environment, cast(id AS varchar) AS ref, recorded_at FROM facts UNION ALL SELECT environment, 'after-' || cast(old_id AS varchar), replaced_at FROM replaced JOIN facts ON id = old_id)),
 c AS (SELECT f.id AS coordinate, f.environment, f.id % 31 AS pos, coalesce(tl.recorded_at, timestamp '2023-12-31') AS known, f.entity, f.predicate FROM facts f LEFT JOIN tl ON tl.environment = f.environment AND tl.place = f.id // 2 WHERE f.id % 20 = 0),
 k AS (SELECT c.coordinate, pos, known, f.* FROM facts f JOIN c ON c.environment = f.environment AND c.entity = f.entity AND c.predicate = f.predicate AND f.recorded_at <= known),
 ends AS (SELECT coordinate, old_id, min(effective) AS until FROM replaced JOIN k ON k.id = old_id AND replaced_at <= known GROUP BY ALL),
 mine AS (SELECT k.* FROM k LEFT JOIN ends ON ends.coordinate = k.coordinate AND old_id = k.id WHERE valid_from <= pos AND pos < coalesce(least(valid_to, until), 1152921504606846976)),
 nc AS (SELECT a.coordinate, count(*) AS n FROM mine a JOIN mine b ON a.coordinate = b.coordinate AND a.id < b.id WHERE CASE WHEN a.negated <> b.negated THEN a.value_json = b.value_json ELSE NOT a.negated AND a.predicate <> 'calls' AND a.value_json <> b.value_json END GROUP BY ALL),
 ns AS (SELECT coordinate, count(*) AS n FROM mine GROUP BY ALL)
 SELECT c.coordinate, c.known, coalesce(ns.n, 0) AS n_selected, coalesce(nc.n, 0) AS n_conflicts, CASE WHEN coalesce(nc.n, 0) > 0 THEN 'conflict' WHEN coalesce(ns.n, 0) > 0 THEN 'supported' ELSE 'unknown' END AS answer FROM c LEFT JOIN ns ON ns.coordinate = c.coordinate LEFT JOIN nc ON nc.coordinate = c.coordinate""",
    "seeded_recall": """WITH s(pos, step) AS (VALUES (0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)) SELECT p_partkey AS case_id, 'original' AS kind, cast(10 * pos + step AS integer) AS coordinate, CASE WHEN pos = 1 AND step = 2 THEN 'superseded' ELSE 'active' END AS status FROM part, s
 UNION ALL SELECT p_partkey, 'changed', cast(10 * pos + step AS integer), CASE WHEN pos = 1 THEN 'active' ELSE 'not_yet_valid' END FROM part, s WHERE step > 0""",
    "workspace_trace": f"""WITH {FACTS_SQL}, ends AS (SELECT old_id, min(effective) AS f, count(*) FILTER (effective <= {AT}) AS n FROM replaced WHERE replaced_at <= timestamp '{KNOWN}' GROUP BY ALL)
SELECT id, CASE WHEN recorded_at > timestamp '{KNOWN}' THEN 'not_known' WHEN environment <> 'env-0' THEN 'different_environment' WHEN entity <> 'user-7' THEN 'different_entity' WHEN predicate <> 'exists' THEN 'different_predicate'
 WHEN valid_from IS NULL THEN 'unknown_validity' WHEN {AT} < valid_from THEN 'not_yet_valid' WHEN {AT} >= least(valid_to, f) THEN CASE WHEN coalesce(n, 0) > 0 THEN 'superseded' ELSE 'expired' END ELSE 'active' END AS reason
FROM facts LEFT JOIN ends ON old_id = id""",
}
