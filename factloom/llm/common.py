"""Table access, bounded samples and Arrow batches shared by the operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session

#: The most frequent values of a label that a sample is drawn for.
MOST_LABELS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{session.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: str, n: int) -> Column:
    """crc32 of the value as text, mod n; a null value counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(n)


def bounded_sample(rows: DataFrame, counts: DataFrame, key: str, label: str, cap: int) -> DataFrame:
    """Rows of each label whose key hashes below cap / count: about cap rows of each label, the same ones in every run.

    counts: the rows that are counted, usually rows without the wide columns. Of more than MOST_LABELS labels the most frequent ones are drawn.
    """
    most = counts.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LABELS)
    sizes = {r[0]: r[1] for r in most.collect()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in sorted(sizes.items()):
        share = F.lit(True) if n <= cap else draw < F.lit(int((1 << 30) * cap / n))
        keep = keep | ((F.col(label) == F.lit(value)) & share)
    return rows.where(keep)


def appended(df: DataFrame, text: str, make, fields: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns that make()(texts) gives for each Arrow batch of df[text].

    make() is called once in each task. A column of df that has the name of a new one gives way to it.
    """
    new = {f.name for f in fields}
    kept = [f.name for f in df.schema if f.name not in new and f.name not in drop]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    kinds = [to_arrow(f.dataType) for f in fields]

    def run(batches):
        scorer = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = batch.column(len(kept)).to_pylist()
            made = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(scorer(texts), kinds, strict=True)]
            old = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(old + made, names=kept + [f.name for f in fields])

    last = "__text"
    while last in df.columns:
        last += "_"
    wide = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(last))
    return wide.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    flat = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}
    return pa.list_(to_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else flat[kind]


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())
