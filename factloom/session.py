"""Make the package importable in Python workers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: dict[str, str] = {}
#: Rows and bytes of an Arrow batch that goes to a Python worker: texts are long, so batches are smaller than by default.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and bound Arrow batches where the session's own settings do not."""
    context = spark.sparkContext
    for key, value in BATCH.items():
        if not context.getConf().contains(key):
            spark.conf.set(key, value)
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        held = tempfile.mkdtemp(prefix="spark-package-")
        context.addPyFile(shutil.make_archive(f"{held}/{root.name}_package", "zip", root.parent, root.name))
        _sent[context.applicationId] = held


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder that was set before.

    Where neither is set, one below the warehouse is set, and a temporary one only if all runs on this machine. On a
    cluster a warehouse on a local disk is refused: other machines do not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        here = context.master == "local" or context.master.startswith("local[")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not here and (warehouse.startswith("file:") or "://" not in warehouse):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} may be this machine's own")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-") if here else f"{warehouse}/_checkpoints")
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage is cut, its columns are pruned and its filters pushed down."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept_in_place(spark: SparkSession):
    """While this holds, joins leave rows where repartition() put them by some of the join's columns; else Spark deals them out again by all of these."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written_in_place(df: DataFrame, name: str) -> DataFrame:
    """As written(), with joins that leave rows where repartition() put them."""
    with kept_in_place(df.sparkSession):
        return written(df, name)
