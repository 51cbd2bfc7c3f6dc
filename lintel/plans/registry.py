"""Names of the queries, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintel.session import deals

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int = 50_000) -> DataFrame:
    """df dealt by key into so many partitions: a small file is one task whatever is made of its rows, and what a task holds does not grow
    with the table."""
    return df.repartition(deals(df, rows), key)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL twin."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add
