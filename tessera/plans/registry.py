"""The registry of queries over the driver's tables, and helpers to lay their rows out as other inputs.

The driver's tables hold no Russian tables, dates or workbooks. Queries of operators that need such inputs derive them
from whole tables, row by row; where an expected value is a rule's (and not an expression of the row), the SQL joins a
list of values derived from the rules by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out over all tasks: a small file is one task, however long each of its rows takes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pick(values: list[str], key: str) -> Column:
    """The value whose place is the key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(key) % len(values) + 1).cast("int"))


def literal(x) -> str:
    """A value as SQL."""
    if x is None or isinstance(x, bool | int | float):
        return {None: "NULL", True: "true", False: "false"}.get(x, str(x)) if not isinstance(x, int | float) or isinstance(x, bool) else str(x)
    if isinstance(x, list | tuple):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'"


def picked(values: list[str], key: str) -> str:
    """``pick`` as SQL."""
    return f"({literal(list(values))})[({key}) % {len(values)} + 1]"


def golden(name: str, columns: str, rows: list[tuple]) -> str:
    """A list of expected values as SQL: the place, then the columns."""
    body = ", ".join("(" + ", ".join([str(i), *map(literal, r)]) + ")" for i, r in enumerate(rows))
    return f"(VALUES {body}) AS {name}(i, {columns})"
