"""Names of the queries, each with its SQL counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(cases: list[str], number: Column) -> Column:
    """The case of a row's number."""
    return F.element_at(F.array(*map(F.lit, cases)), (F.pmod(number, F.lit(len(cases))) + 1).cast("int"))


def sql_pick(cases: list[str], number: str) -> str:
    return f"([{', '.join(map(sql_text, cases))}])[(({number}) % {len(cases)}) + 1]"
