"""Registration of queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sql_views import SQL_VIEWS
from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Plain output types: floats rounded to 6 decimals, integers as BIGINT, dates and times as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)


def oracle_statement(
    body: str,
    views: Sequence[str] = (),
    doubles: Sequence[str] = (),
    ints: Sequence[str] = (),
    texts: Sequence[str] = (),
) -> str:
    """The body after the WITH list it needs, with the same output types as `comparable`."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in SQL_VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        add(name)
    replaced = [
        *[f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles],
        *[f"CAST({c} AS BIGINT) AS {c}" for c in ints],
        *[f"CAST({c} AS VARCHAR) AS {c}" for c in texts],
    ]
    ctes = [f"{name} AS ({SQL_VIEWS[name][1]})" for name in ordered] + [f"_result AS ({body})"]
    star = f"* REPLACE ({', '.join(replaced)})" if replaced else "*"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {star} FROM _result"


def register(
    name: str,
    sql: str | None = None,
    views: Sequence[str] = (),
    doubles: Sequence[str] = (),
    ints: Sequence[str] = (),
    texts: Sequence[str] = (),
) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Register a function of the test views under `name`, with its SQL unless the result is not SQL."""

    def wrap(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(build(Views(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = oracle_statement(sql, views, doubles, ints, texts)
        return build

    return wrap
