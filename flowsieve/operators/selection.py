"""The first (or last) ``k`` rows of every key without sorting or numbering all rows.

Rows are cut by a histogram: one aggregation gives rows, least and greatest order
value per key; keys with more than ``k`` rows get a histogram of ``BINS`` equal
steps; the bin in which the ``k``-th row lies bounds what can be among the first
``k``.  Only rows up to that bin, ``k`` and one bin's worth per key, are ranked
exactly.  Both aggregations are partial before their shuffle and read the keys and
the order value alone; keys with at most ``k`` rows are never ranked to be cut.
Only keys with more than ``k`` rows are looked up, at most rows / ``k`` of them; from
``BROADCAST_FROM`` on they are broadcast, so that no row moves before the cut.

Order values are numbers, times or dates (other first order columns are ranked
without the cut).  Nulls come first in ascending and last in descending order, as
in a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps of a key's histogram.
BINS = 1024
#: Least ``k`` at which the keys with more than ``k`` rows are few enough to broadcast: at most a thousandth of the rows.
BROADCAST_FROM = 1000
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _number(df: DataFrame, name: str) -> Column | None:
    """An order column as a double that rises with it, or None."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col(name)).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    return F.col(name).cast("double") if isinstance(kind, T.NumericType) else None


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Step of ``v`` among ``bins`` equal ones; null and NaN are steps of their own at the ends where a sort puts them."""
    step = F.floor((v - low) / (high - low) * bins)
    inside = F.when(high > low, F.greatest(F.lit(0), F.least(step, F.lit(bins - 1)))).otherwise(F.lit(0))
    return F.when(v.isNull(), -1).when(F.isnan(v), bins).otherwise(inside).cast("int")


def _order(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def up_to_bin(df: DataFrame, keys: list[str], order: list[str], k: int, descending: bool = False,
              bins: int = BINS) -> DataFrame:
    """``df`` without rows that cannot be among the first ``k`` of their key; keys of at most ``k`` rows are whole."""
    v = _number(df, order[0])
    if v is None:
        return df
    rows = df.withColumn("__v", v).withColumn("__key_of_row", F.struct(*[F.col(c) for c in keys]) if keys else F.lit(0))
    finite = F.when(~F.isnan("__v"), F.col("__v"))
    large = (rows.groupBy("__key_of_row").agg(F.count(F.lit(1)).alias("__n"), F.min(finite).alias("__low"), F.max(finite).alias("__high"))
             .where(F.col("__n") > k))
    few = F.broadcast if k >= BROADCAST_FROM else (lambda side: side)
    where = _bin(F.col("__v"), F.col("__low"), F.col("__high"), bins)
    steps = (rows.select("__key_of_row", "__v").join(few(large), "__key_of_row").groupBy("__key_of_row", "__low", "__high", where.alias("__bin"))
             .agg(F.count(F.lit(1)).alias("__c")))  # at most bins + 2 rows a key
    so_far = Window.partitionBy("__key_of_row").orderBy(F.desc("__bin") if descending else F.asc("__bin"))
    edge = (steps.withColumn("__before", F.sum("__c").over(so_far) - F.col("__c")).where(F.col("__before") < k)
            .groupBy("__key_of_row", "__low", "__high")
            .agg((F.min("__bin") if descending else F.max("__bin")).alias("__edge")))
    kept = rows.join(few(edge), "__key_of_row", "left")
    within = where >= F.col("__edge") if descending else where <= F.col("__edge")
    return kept.where(F.col("__edge").isNull() | within).select(*df.columns)


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int, name: str = "rn", descending: bool = False,
            bins: int = BINS) -> DataFrame:
    """The first ``k`` rows of every key in ``order``, with their rank (from 1) as ``name``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order, descending)))
    return up_to_bin(df, keys, order, k, descending, bins).withColumn(name, rank).where(F.col(name) <= k)


def kth(df: DataFrame, keys: list[str], order: list[str], k: int, name: str, descending: bool = False,
        bins: int = BINS) -> DataFrame:
    """Per key with more than ``k`` rows the order columns (a struct) of its ``k``-th row."""
    slim = df.select(*keys, *order)
    ranked = first_k(slim, keys, order, k + 1, "__rank", descending, bins)
    at = F.struct(*[F.col(c) for c in order])
    return (ranked.groupBy(*keys).agg(F.max(F.when(F.col("__rank") == k, at)).alias(name), F.max("__rank").alias("__most"))
            .where(F.col("__most") > k).drop("__most"))
