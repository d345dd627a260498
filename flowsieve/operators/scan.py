"""Running numbers, running sums and running maxima per key, without hot tasks.

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of one key in one
task, and an un-partitioned window puts the whole table in one task.  Both break
when one key holds a third of the rows.  ``running`` instead:

1. draws a bounded sample of the sort key ``(keys, order)`` and picks slice
   boundaries from it, so a hot key is cut into many contiguous slices of its
   order; the sample is a scalar subquery of the plan, nothing runs while a query
   is built;
2. tags every row with its slice number, a binary search in the boundaries and so
   a pure function of the row: a retried task always agrees;
3. deals the rows once, by (slice, key), several slices for each task, and computes
   the running aggregate inside each (slice, key) with an ordinary window, which
   needs no further exchange;
4. aggregates one row per (slice, key) with partial aggregation, turns those into
   offsets with a window over that small table and joins them back by the same
   (slice, key), for which the rows already lie right.

Keys are compared as one struct, in which nulls are equal.  Sums add their offset,
maxima take the greater of local value and offset.  Orders are ascending; order
keys must be unique within a key where ties matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_partitions

_KINDS = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_SAMPLES_PER_SLICE = 20
#: Slices are hashed to tasks, so a task gets several small ones rather than one or none.
_SLICES_PER_TASK = 4
_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _primitive(col: Column, dtype: T.DataType) -> list[Column]:
    """Order-preserving primitive columns for one sort column."""
    if isinstance(dtype, T.StructType):
        out = []
        for f in dtype.fields:
            out += _primitive(col.getField(f.name), f.dataType)
        return out
    if isinstance(dtype, T.TimestampNTZType):
        return [F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), col)]
    if isinstance(dtype, T.TimestampType):
        return [F.unix_micros(col)]
    if isinstance(dtype, T.DateType):
        return [F.unix_date(col)]
    return [col]


def _sort_key(df: DataFrame, cols: list[Column]) -> list[Column]:
    types = df.select(*[c.alias(f"__k{i}") for i, c in enumerate(cols)]).schema
    prims = []
    for c, f in zip(cols, types.fields):
        prims += _primitive(c, f.dataType)
    return prims


def _boundaries(df: DataFrame, key: Column, parts: list[Column], n: int) -> Column:
    """Array of ``n - 1`` sampled boundaries of ``key`` in ascending order (empty for no rows), found when the plan runs.

    The sample is the ``_SAMPLES_PER_SLICE * n`` rows with the least hash.
    """
    drawn = (df.select(key.alias("k"), F.xxhash64(*parts).alias("h")).orderBy("h").limit(_SAMPLES_PER_SLICE * n)
             .agg(F.sort_array(F.collect_list("k")).alias("s")))
    m = F.size("s")
    at = F.transform(F.sequence(F.lit(1), F.lit(max(n - 1, 1))),
                     lambda i: F.element_at("s", F.least(m, F.floor(i * m / n).cast("int") + 1)))
    return drawn.select(F.when((m > 0) & F.lit(n > 1), at).otherwise(F.slice("s", 1, 0)).alias("b")).scalar()


def with_slice(df: DataFrame, sort_cols: list[Column], n: int, sample_from: DataFrame | None = None,
               name: str = "__pid") -> DataFrame:
    """``df`` with the slice of each row: number of boundaries at or below its sort key.

    Boundaries only balance the slices -- any boundaries give correct results --
    so they may be sampled from ``sample_from``, a cheaper frame with the same
    key columns (e.g. the rows before an expensive join), instead of ``df``.  The
    search takes one projection per halving; a step that is used twice is computed
    once.
    """
    prims = _sort_key(df, sort_cols)
    key = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prims)])
    bounds = _boundaries(sample_from if sample_from is not None else df, key, prims, n)
    out = df.select("*", key.alias("__key"), F.lit(0).alias(name))
    for i in reversed(range(max(n - 1, 1).bit_length())):
        reached = F.coalesce(F.try_element_at(bounds, F.col(name) + (1 << i)) <= F.col("__key"), F.lit(False))
        out = out.withColumn(name, F.col(name) + F.when(reached, 1 << i).otherwise(0))
    return out.drop("__key")


def _slices(df: DataFrame) -> int:
    return _SLICES_PER_TASK * shuffle_partitions(df.sparkSession)


def _group(keys: list[str]) -> Column:
    """All keys as one column without nulls of its own."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def dealt(tagged: DataFrame) -> DataFrame:
    """Rows dealt by slice and key.

    Rows that already lie by their key (after a join on it) would satisfy the
    window without an exchange, and a hot key would stay in one task.
    """
    return tagged.repartition("__pid", "__gk")


def running(df: DataFrame, keys: list[str], order: list, aggs: dict,
            inclusive: bool = True, totals: bool = False,
            num_partitions: int | None = None, sample_from: DataFrame | None = None) -> DataFrame:
    """Append running aggregates per ``keys`` in ascending ``order``.

    ``aggs`` maps an output name to ``(kind, column)`` with kind ``count``
    (column ignored), ``sum``, ``max`` or ``min``.  ``inclusive=False`` leaves
    the current row out (the value "before" the row).  With ``totals=True``
    each aggregate also gets ``<name>_total`` over the whole key.
    """
    n = num_partitions or _slices(df)
    base_cols = df.columns
    inputs = []
    for name, (kind, expr) in aggs.items():
        src = F.lit(1).cast("long") if kind == "count" else _as_col(expr)
        inputs.append(src.alias(f"__in_{name}"))
    order_cols = [_as_col(c) for c in order]

    sort = [F.col(k) for k in keys] + order_cols
    tagged = with_slice(df, sort, n, sample_from).select("*", *inputs, _group(keys).alias("__gk"))
    frame_end = Window.currentRow if inclusive else -1
    w_local = (Window.partitionBy("__pid", "__gk").orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, frame_end))
    local = dealt(tagged).select(
        "*", *[_KINDS[kind](f"__in_{name}").over(w_local).alias(f"__loc_{name}")
               for name, (kind, _) in aggs.items()])

    slices = tagged.groupBy("__pid", "__gk").agg(
        *[_KINDS[kind](f"__in_{name}").alias(f"__tot_{name}") for name, (kind, _) in aggs.items()])
    w_prev = Window.partitionBy("__gk").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy("__gk")
    off_cols = [_KINDS[kind](f"__tot_{name}").over(w_prev).alias(f"__off_{name}")
                for name, (kind, _) in aggs.items()]
    if totals:
        off_cols += [_KINDS[kind](f"__tot_{name}").over(w_all).alias(f"__all_{name}")
                     for name, (kind, _) in aggs.items()]
    joined = local.join(slices.select("__pid", "__gk", *off_cols), ["__pid", "__gk"])

    outs = []
    for name, (kind, _) in aggs.items():
        loc, off = F.col(f"__loc_{name}"), F.col(f"__off_{name}")
        if kind in ("sum", "count"):
            value = F.coalesce(loc, F.lit(0)) + F.coalesce(off, F.lit(0))
        elif kind == "max":
            value = F.greatest(loc, off)
        else:
            value = F.least(loc, off)
        outs.append(value.alias(name))
        if totals:
            outs.append(F.col(f"__all_{name}").alias(f"{name}_total"))
    return joined.select(*[F.col(c) for c in base_cols], *outs)


def count_since_reset(df: DataFrame, keys: list[str], order: list, inc: Column, reset: Column,
                      name: str, sample_from: DataFrame | None = None, start: Column | None = None) -> DataFrame:
    """Running sum of ``inc`` since the latest row where ``reset`` holds (reset rows give 0 there).

    ``start`` is what a key has counted before its first row here; null counts as 0.

    One pass: with A = running sum of ``inc`` and M = A at the latest reset row,
    the answer is ``A - M``.  Inside a slice both come from one window; across
    slices A gets the summed totals of earlier slices and M the largest
    ``(slice's last reset A) + (that slice's offset)`` of earlier slices, both
    computed over the small per-slice table.  ``inc`` must be non-negative.
    """
    base_cols = df.columns
    order_cols = [_as_col(c) for c in order]
    tagged = dealt(with_slice(df, [F.col(k) for k in keys] + order_cols, _slices(df), sample_from).select(
        "*", inc.cast("long").alias("__inc"), reset.alias("__reset"), _group(keys).alias("__gk")))
    w_local = (Window.partitionBy("__pid", "__gk").orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    a_loc = F.sum("__inc").over(w_local)
    local = tagged.select("*", a_loc.alias("__a"))
    local = local.withColumn("__m", F.max(F.when(F.col("__reset"), F.col("__a"))).over(w_local))
    slices = local.groupBy("__pid", "__gk").agg(F.sum("__inc").alias("__t"),
                                                F.max(F.when(F.col("__reset"), F.col("__a"))).alias("__r"))
    w_prev = Window.partitionBy("__gk").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("__off_a", F.coalesce(F.sum("__t").over(w_prev), F.lit(0)))
    slices = slices.withColumn("__r_glob", F.col("__r") + F.col("__off_a"))
    offsets = slices.select("__pid", "__gk", "__off_a", F.max("__r_glob").over(w_prev).alias("__off_m"))
    joined = local.join(offsets, ["__pid", "__gk"])
    a = F.col("__a") + F.col("__off_a")
    m = F.greatest(F.col("__m") + F.col("__off_a"), F.col("__off_m"))
    return joined.select(*[F.col(c) for c in base_cols], (a - F.coalesce(m, -start if start is not None else F.lit(0), F.lit(0))).alias(name))


def row_number(df: DataFrame, keys: list[str], order: list, name: str = "rn",
               totals: bool = False, num_partitions: int | None = None,
               sample_from: DataFrame | None = None) -> DataFrame:
    """1-based position of each row within its key in ``order`` (unique order keys)."""
    return running(df, keys, order, {name: ("count", None)}, totals=totals,
                   num_partitions=num_partitions, sample_from=sample_from)


def previous_value(df: DataFrame, keys: list[str], order: list, value: str,
                   name: str) -> DataFrame:
    """Value of ``value`` on the previous row of the same key (null on the first row).

    Computed as the running maximum, excluding the current row, of a struct
    that starts with the order keys; so it is the last row before this one.
    """
    packed = F.struct(*[_as_col(c) for c in order], F.col(value).alias("__v"))
    out = running(df, keys, order, {f"__prev_{name}": ("max", packed)}, inclusive=False)
    return out.withColumn(name, F.col(f"__prev_{name}.__v")).drop(f"__prev_{name}")
