"""The query registry: each operator over the given tables, with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, tuple[str, list[str]]] = {}
PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, sql: str, needs: list[str] | None = None) -> None:
    """A named sub-query other SQL may build on."""
    PARTS[name] = (needs or [], sql)


def with_parts(body: str, needs: list[str]) -> str:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for n in PARTS[name][0]:
            visit(n)
        done.append(name)

    for n in needs:
        visit(n)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{PARTS[n][1].strip()}\n)" for n in done) + "\n" + body


def query(name: str, sql: str | None = None, needs: list[str] | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` builds on the parts named in ``needs``."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = (sql.strip(), needs or [])
        return fn
    return register


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and decimals as DOUBLE, so both engines report one schema."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def reference_sql() -> dict[str, str]:
    """The full SQL of every query that has one."""
    return {name: with_parts(body, needs) for name, (body, needs) in SQL.items()}
