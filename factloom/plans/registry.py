"""Names of the registered queries and of the SQL that states the same result."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from factloom import session

from . import code, dialogue, evaluation, journal, search

PARTS = (journal, search, dialogue, code, evaluation)


def prepared(query):
    """query, with the package on the executors, times in UTC and a checkpoint folder where none is set."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session.ship(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        session.shared_folder(spark)
        return query(spark, sf_dir)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["recall_combined"](spark, sf_dir)


def queries() -> dict:
    return {name: prepared(q) for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
