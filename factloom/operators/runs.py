"""Immutable result documents with parents, and recalls kept by what they depend on."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import journal

SCHEMA = "id string, payload string, parent_id string"


def new_runs(batch: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows to append for a batch (payload, parent_id): content ids, known ones left out; an unknown parent fails the batch."""
    payload = journal.canonical_value("payload")
    named = batch.select(payload.alias("payload"), "parent_id")
    named = named.withColumn("payload", F.when(F.get_json_object("payload", "$.run_id").isNotNull(), F.raise_error(F.lit("a run document does not name itself"))).otherwise(F.col("payload")))
    named = named.withColumn("id", F.sha2(F.concat_ws("|", "payload", F.coalesce("parent_id", F.lit(""))), 256)).dropDuplicates(["id"])
    parents = runs.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    met = named.join(parents, "parent_id", "left")
    fine = met.withColumn("payload", F.when(F.col("parent_id").isNotNull() & F.col("known").isNull(), F.raise_error(F.lit("unknown parent"))).otherwise(F.col("payload")))
    return fine.join(runs.select("id"), "id", "left_anti").select("id", "payload", "parent_id")


def get(runs: DataFrame, run_id: str) -> str:
    """The payload of a run; a missing id or a payload that no longer has its id is an error."""
    row = runs.where(F.col("id") == run_id).select("payload", (F.sha2(F.concat_ws("|", "payload", F.coalesce("parent_id", F.lit(""))), 256) == F.col("id")).alias("fine")).first()
    if row is None:
        raise KeyError(run_id)
    if not row["fine"]:
        raise ValueError("stored run differs from its id")
    return row["payload"]


def recall_key(rules: str, revision: int, at: int, known: str, scope: dict, entity: str | None, mode: str) -> str:
    """The digest of all that a recall depends on: rules, revision and coordinates."""
    return hashlib.sha256(json.dumps([rules, revision, at, known, scope, entity, mode], ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Recalls:
    """The last recalls by recall_key(), as persisted tables; the oldest is let go beyond a size."""

    def __init__(self, size: int = 128):
        self.size, self.held = size, OrderedDict()

    def get(self, key: str, make) -> tuple[DataFrame, bool]:
        """(table, whether it was held)."""
        hit = key in self.held
        if not hit:
            self.held[key] = make().persist()
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)[1].unpersist()
        return self.held[key], hit
