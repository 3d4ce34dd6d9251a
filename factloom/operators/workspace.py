"""Isolated workspaces on the journal: guards, a strictly rising clock, and a snapshot that explains every fact."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import session

from . import journal

# Limits of a workspace and its predicates; the clock of seeded cases.
MOST_FACTS, MOST_POSITION, MOST_SCALAR = 80, 100, 500
MOST_TEXT = {"entity": 160, "environment": 40, "source": 300, "text": 1500, "agent": 80}
PREDICATES = ("default", "signature", "exists", "parameter_exists", "calls")
KNOWLEDGE = ("2026-09-01 00:00:00", "2026-09-02 00:00:00", "2026-09-03 00:00:00")
# End of fixed values.
#: The scope of seeded cases.
CASES = ("cases", "seeded", "default")


def new_room() -> str:
    """A workspace id; it becomes the branch of the workspace's facts."""
    return uuid.uuid4().hex


def checked_room(room: str) -> str:
    if not isinstance(room, str) or not re.fullmatch(r"[0-9a-f]{32}", room):
        raise ValueError("not a workspace id")
    return room


def checked_text(value, most: int) -> str:
    if not isinstance(value, str) or not value.strip() or len(value) > most:
        raise ValueError(f"text of 1 to {most} characters is asked for")
    return value.strip()


def checked_position(value) -> int:
    if type(value) is not int or not 0 <= value <= MOST_POSITION:
        raise ValueError(f"a whole number from 0 to {MOST_POSITION} is asked for")
    return value


def next_time(now: datetime, last: datetime | None) -> datetime:
    """now, or a microsecond after the last event if that is later."""
    return now if last is None or now > last else last + timedelta(microseconds=1)


def within_limits(facts: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """facts; the batch fails if a workspace would hold more facts than allowed, or one breaks a limit of predicates, positions, values or texts. held: what the journal has."""
    said = lambda c: F.coalesce(F.get_json_object("evidence_json", f"$.{c}"), F.lit(""))
    long = (F.length("entity") > MOST_TEXT["entity"]) | (F.length("environment") > MOST_TEXT["environment"])
    for name in ("source", "text", "agent"):
        long = long | (F.length(said(name)) > MOST_TEXT[name])
    bad = (F.col("valid_from") > MOST_POSITION) | (F.col("valid_to") > MOST_POSITION) | (F.length("value_json") > MOST_SCALAR + 2) | F.col("value_json").rlike(r"^\s*[\[{]") | ~F.col("predicate").isin(*PREDICATES) | long
    fine = facts.withColumn("entity", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("outside the workspace's limits"))).otherwise(F.col("entity")))
    rooms = facts.select("branch") if held is None else facts.select("branch").unionByName(held.join(facts.select("branch").distinct(), "branch", "left_semi").select("branch"))
    crowded = rooms.groupBy("branch").agg(F.count("*").alias("n")).where(F.col("n") > MOST_FACTS).agg(F.count("*").alias("crowded"))
    return fine.crossJoin(F.broadcast(crowded)).withColumn("entity", F.when(F.col("crowded") > 0, F.raise_error(F.lit("too many facts"))).otherwise(F.col("entity"))).drop("crowded")


def known_time(events: DataFrame, position: int, created: datetime) -> datetime:
    """The time up to which the first position events of a workspace are known; its creation for none."""
    if position == 0:
        return created
    row = events.orderBy("recorded_at", "ref").limit(position).agg(F.max("recorded_at")).first()
    return row[0] or created


def trace(facts: DataFrame, replaced: DataFrame, coordinates: DataFrame, entity: str | None = None, predicate: str | None = None) -> DataFrame:
    """Every fact of the journal with the reason why a snapshot shows it or not, the first that applies.

    coordinates: one row, as for journal.derived().
    """
    status = journal.derived(facts, replaced, coordinates).select("id", "status", "effective_to")
    here = coordinates.select("known", F.col("environment").alias("wanted"))
    reason = F.when(F.col("recorded_at") > F.col("known"), "not_known").when(F.col("environment") != F.col("wanted"), "different_environment")
    if entity is not None:
        reason = reason.when(F.col("entity") != entity, "different_entity")
    if predicate is not None:
        reason = reason.when(F.col("predicate") != predicate, "different_predicate")
    return facts.crossJoin(F.broadcast(here)).join(status, "id", "left").withColumn("reason", reason.otherwise(F.col("status"))).drop("wanted", "known")


def cutoffs(events: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (coordinate, scope columns, at, position, created) with known, the time of the event at that place of the scope's history, created for place 0.

    events: journal.timeline(). A place beyond the history is an error.
    """
    met = requests.join(events.select(*journal.SCOPE, F.col("place").alias("position"), F.col("recorded_at").alias("reached")), [*journal.SCOPE, "position"], "left")
    missing = (F.col("position") > 0) & F.col("reached").isNull()
    return met.withColumn("known", F.when(F.col("position") == 0, F.col("created")).when(missing, F.raise_error(F.lit("a place outside the journal")).cast("timestamp")).otherwise(F.col("reached"))).drop("reached")


def snapshots(facts: DataFrame, replaced: DataFrame, requests: DataFrame) -> DataFrame:
    """One row for each request (coordinate, scope columns, at, position, created, entity, predicate): known, n_selected, n_conflicts and answer of the facts about its subject.

    requests may be as many as events: a request meets the facts about its own subject only.
    """
    at = session.written(cutoffs(journal.timeline(facts, replaced), requests), "requests")
    rows = session.written(journal.derived(facts, replaced, at), "snapshots")
    return journal.answers(rows, at, "combined").drop("mode").join(at.select("coordinate", "known"), "coordinate")


def seeded(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, replacements) of controlled cases (case_id, entity, original, changed, source, text): the original, a change of it, and its replacement at three times."""
    kinds = F.explode(F.array(F.struct(F.lit("original").alias("kind"), F.col("original").alias("value_json")), F.struct(F.lit("changed").alias("kind"), F.col("changed").alias("value_json")))).alias("k")
    rows = cases.select("case_id", "entity", "source", "text", kinds).select("case_id", "entity", "source", "text", "k.*")
    first = F.col("kind") == "original"
    told = F.struct(F.when(first, F.col("source")).otherwise(F.concat("source", F.lit("#changed"))).alias("source"), F.when(first, F.col("text")).otherwise(F.concat(F.lit("Changed to "), F.col("value_json"))).alias("text"))
    facts = rows.select(
        "case_id", "kind", "entity", F.lit("default").alias("predicate"), "value_json", *[F.lit(v).alias(c) for c, v in zip(journal.SCOPE, CASES, strict=True)],
        F.when(first, 0).otherwise(1).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.when(first, F.lit(KNOWLEDGE[0])).otherwise(F.lit(KNOWLEDGE[1])).cast("timestamp").alias("recorded_at"), F.to_json(told).alias("evidence_json"), F.lit(False).alias("negated"),
    )
    facts = journal.identified(facts)
    pairs = facts.groupBy("case_id").agg(F.max(F.when(F.col("kind") == "original", F.col("id"))).alias("old_id"), F.max(F.when(F.col("kind") == "changed", F.col("id"))).alias("new_id"))
    return facts, pairs.select("old_id", "new_id", F.lit(1).cast("long").alias("effective"), F.lit(KNOWLEDGE[2]).cast("timestamp").alias("recorded_at"))


def knowledge_coordinates(spark: SparkSession, positions: list[int]) -> DataFrame:
    """Coordinates of every position with every step of the seeded cases' knowledge: coordinate is 10 times the position plus the step."""
    rows = [(10 * at + step, at, known, *CASES) for at in positions for step, known in enumerate(KNOWLEDGE)]
    return spark.createDataFrame(rows, "coordinate int, at long, known string, repository string, branch string, environment string").withColumn("known", F.to_timestamp("known"))


def intact(fixture: DataFrame) -> DataFrame:
    """fixture (name, payload, content_hash); the batch fails if a payload, in canonical form, has another hash."""
    fine = F.sha2(journal.in_canonical_form("payload"), 256) == F.col("content_hash")
    return fixture.withColumn("payload", F.when(fine, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("fixture differs from its hash: "), F.col("name")))))
