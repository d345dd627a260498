"""Registry of named queries: a Spark builder and, when SQL can express it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: ``fn(spark, sf_dir) -> DataFrame`` registered under ``name``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


# -- output normalisation shared by queries and oracles ---------------------

DIGITS = 6


def r(c, digits: int = DIGITS) -> Column:
    """Round half away from zero with plain IEEE double steps.

    Spark's ``round`` works on the decimal text of a double and DuckDB's on
    ``x * 10^d``; at exact ties they differ.  This formula (and ``sr`` for the
    oracle) uses only operations both engines compute bit-identically.
    """
    col = c if isinstance(c, Column) else F.col(c)
    x = col.cast("double")
    scale = F.lit(float(10 ** digits))

    def up(v):
        z = v * scale + F.lit(0.5)
        return (z - z % F.lit(1.0)) / scale

    return F.when(x < 0, -up(-x)).otherwise(up(x))


def sr(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of ``r``."""
    s = f"cast({10 ** digits} AS double)"
    x = f"cast(({expr}) AS double)"

    def up(v):
        z = f"({v} * {s} + 0.5)"
        return f"(({z} - ({z} % 1.0)) / {s})"

    return f"(CASE WHEN {x} < 0 THEN -{up('-' + x)} ELSE {up(x)} END)"


def ts_text(c) -> Column:
    col = c if isinstance(c, Column) else F.col(c)
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def sql_ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
