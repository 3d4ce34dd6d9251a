"""The journal on disk: tables of facts, replacements and runs that only grow, and the write path as a stream.

Identity is by content and has no bound in time, so a batch is held against the journal itself, not against a
watermark. A batch that comes again, by a replay or from another stream, finds its rows there and adds nothing; so
batch numbers never decide what is written. One writer at a time is assumed, as for any plain folder of Parquet files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factloom.operators import journal, runs

FACTS = "entity string, predicate string, value_json string, repository string, branch string, environment string, valid_from long, valid_to long, recorded_at timestamp, evidence_json string, negated boolean"
PROPOSALS = "old_id string, new_id string, effective long, recorded_at timestamp"
#: The journal's tables; write is a name of its own for each append.
TABLES = {"facts": f"{FACTS}, id string, write string", "replacements": f"{PROPOSALS}, id string, write string", "runs": f"{runs.SCHEMA}, write string", "rooms": "id string, created timestamp, write string"}


def held(spark: SparkSession, path: str, table: str = "facts") -> DataFrame:
    """A table of the journal at path; empty before the first write."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(TABLES[table]).parquet(f"{path}/{table}") if there else spark.createDataFrame([], TABLES[table])


def revision(spark: SparkSession, path: str) -> int:
    """How many writes of facts or replacements brought something new."""
    writes = held(spark, path).select("write").unionByName(held(spark, path, "replacements").select("write"))
    return writes.distinct().count()


def added(new: DataFrame, path: str, table: str) -> None:
    names = [x.split()[0] for x in TABLES[table].split(", ")]
    new.withColumn("write", F.lit(uuid.uuid4().hex)).select(*names).write.mode("append").parquet(f"{path}/{table}")


def append(batch: DataFrame, path: str) -> None:
    """Append the facts of a batch that the journal lacks; all of it fails if one fact is wrong."""
    added(journal.fresh(batch, held(batch.sparkSession, path)), path, "facts")


def supersede(proposals: DataFrame, path: str) -> None:
    """Append replacements; all of them fail if one is refused, for a rule or for a cycle with the journal's or the batch's own."""
    spark = proposals.sparkSession
    added(journal.superseded(proposals, held(spark, path), held(spark, path, "replacements")), path, "replacements")


def save_runs(batch: DataFrame, path: str) -> None:
    """Append result documents (payload, parent_id) that are not there yet."""
    added(runs.new_runs(batch, held(batch.sparkSession, path, "runs").select("id", "payload", "parent_id")), path, "runs")


def written(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start the write path for a stream of facts; it ends when what is there has been read. Any number of streams may write one after the other."""
    return stream.writeStream.foreachBatch(lambda df, _: append(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class OpenMemories(StatefulProcessor):
    """Per owner and text, the still open points, last in first out; an update closes the latest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", T.StructType([T.StructField("since", T.TimestampType())]))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        stack = [r[0] for r in self.open.get()] if self.open.exists() else []
        closed = []
        for part in rows:
            for since, shuts in part.sort_values("since")[["since", "shuts"]].itertuples(index=False):
                if shuts and stack:
                    closed.append((*key, stack.pop(), since))
                if not shuts:
                    stack.append(since)
        self.open.put([(s,) for s in stack]) if stack else self.open.clear()
        yield pd.DataFrame(closed, columns=["owner", "key", "since", "until"])

    def close(self) -> None:
        pass


def linked(stream: DataFrame) -> DataFrame:
    """(owner, key, since, until) of points that updates in a stream (owner, key, since, shuts) close, as they come in."""
    return stream.groupBy("owner", "key").transformWithStateInPandas(OpenMemories(), outputStructType="owner string, key string, since timestamp, until timestamp", outputMode="Append", timeMode="None")
