"""Readers and writers of the file formats: JSON documents and lines, Parquet, text sources, manifests, gzip comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOL = "struct<symbol:string,relationships:array<struct<symbol:string,isImplementation:boolean>>>"
OCCURRENCE = "struct<symbol:string,symbolRoles:int,range:array<int>,enclosingRange:array<int>>"
PROJECTION = f"documents array<struct<relativePath:string,symbols:array<{SYMBOL}>,occurrences:array<{OCCURRENCE}>>>"
SESSION = "struct<memory_points:array<struct<memory_content:string,timestamp:string,is_update:string,original_memories:array<string>>>,questions:array<struct<question:string,question_type:string,evidence:array<string>>>,end_time:string>"
TIMED_USERS = f"uuid string, sessions array<{SESSION}>"


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document in each file, with a stated schema; nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parquet(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A Parquet table, of named sources only if names are given; the filter reaches the scan."""
    rows = spark.read.parquet(path)
    return rows if names is None else rows.where(F.col("source").isin(*names))


def texts(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(path, text) of whole files below a folder; files that wanted (path) names and that are not there have empty text."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/").alias("full"), F.col("value").alias("text"))
    prefix = folder.rstrip("/") + "/"
    found = files.select(F.replace("full", F.lit(prefix), F.lit("")).alias("path"), "text")
    return found if wanted is None else wanted.select("path").join(found, "path", "left").withColumn("text", F.coalesce("text", F.lit("")))


def projection_tables(projection: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, relationships, occurrences) of a code projection; only the columns that are used are read."""
    docs = projection.select(F.posexplode("documents").alias("file", "d"))
    symbols = docs.select(F.col("d.relativePath").alias("source_path"), "file", F.posexplode("d.symbols").alias("nth", "s"))
    ids = symbols.select(F.col("s.symbol").alias("id"), (F.col("file").cast("long") * (1 << 32) + F.col("nth")).alias("ord"), "source_path")
    related = symbols.select(F.col("s.symbol").alias("id"), F.explode("s.relationships").alias("r")).select("id", F.col("r.symbol").alias("target"), F.coalesce("r.isImplementation", F.lit(False)).alias("is_implementation"))
    places = docs.select(F.col("d.relativePath").alias("path"), "file", F.posexplode("d.occurrences").alias("nth", "o"))
    seen = places.select("path", F.struct("file", "nth").alias("point"), F.col("o.symbol").alias("symbol"), (F.col("o.symbolRoles").bitwiseAND(1) == 1).alias("is_definition"), F.col("o.range").alias("range"), F.col("o.enclosingRange").alias("enclosing"))
    return ids, related, seen


def timed_points(users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, questions) of users with sessions, in order of appearance: owner, session, pos."""
    sessions = users.select(F.col("uuid").alias("owner"), F.posexplode("sessions").alias("session", "s"))
    points = sessions.select("owner", "session", F.posexplode("s.memory_points").alias("nth", "m")).select("owner", "session", F.struct("session", "nth").alias("pos"), F.col("m.memory_content").alias("text"), F.col("m.timestamp").alias("timestamp"), F.coalesce("m.original_memories", F.array().cast("array<string>")).alias("closes"))
    questions = sessions.select("owner", "session", F.col("s.end_time").alias("end_time"), F.posexplode("s.questions").alias("nth", "q")).select("owner", "session", "nth", "end_time", "q.*")
    return points, questions


def verified(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Files of a manifest (path, sha256) that are missing, differ or lie outside the folder: path, flaw. Empty when all is well."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    prefix = folder.rstrip("/") + "/"
    have = files.select(F.replace(F.regexp_replace("path", r"^file:/+", "/"), F.lit(prefix), F.lit("")).alias("path"), F.sha2("content", 256).alias("found"))
    out = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    flaw = F.when(out, "outside").when(F.col("found").isNull(), "missing").when(F.lower("sha256") != F.col("found"), "different")
    return manifest.join(have, "path", "left").select("path", flaw.alias("flaw")).where("flaw IS NOT NULL")


def write_json(rows: DataFrame, path: str, detail: tuple[str, ...] = ()) -> None:
    """rows as JSON lines without the named detail columns; nulls are written out. An existing path is an error."""
    rows.drop(*detail).write.option("ignoreNullFields", False).json(path)


def same_rows(spark: SparkSession, left: str, right: str, schema: T.StructType | str) -> bool:
    """Whether two JSON-lines files, gzipped or not, hold the same rows, as often."""
    a, b = (json_lines(spark, p, schema) for p in (left, right))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
