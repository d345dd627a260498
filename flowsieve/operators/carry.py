"""Carry-over windows: a window with too few packets rolls into the next one.

The rule is sequential: the packets carried into a window decide whether it
closes.  But a window acts on the carried count (0 .. m - 1, ``m`` the least
number of packets) as a function: carried count -> (next carried count, windows
closed).  Functions compose, so the walk is a scan:

* up: windows lie on a regular grid, so ``BLOCK`` neighbouring ones form a block
  by number alone; a block's functions are composed into one, ``BLOCK`` blocks
  into one of the next level, and so on;
* down: each key starts with nothing carried; a block that knows its start tells
  every child its own.

Every array holds at most ``BLOCK`` entries, levels shrink by that factor, and a
key with a third of all windows is many blocks.  In the end each window knows how
many were closed before it, which names the group that it belongs to; a group has
at most ``m`` windows, and its features come from mergeable aggregates.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import MIN_WINDOW_PACKETS, PORT_PROTOCOLS, TCP_FLAG_BITS
from ..functions import packets as pk
from . import windows

#: Neighbours composed at once.
BLOCK = 512
#: Microseconds that any table of packets may span around 1970.
SPAN_US = 1e16
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _micros(df: DataFrame, name: str) -> Column:
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col(name))
    return F.unix_micros(F.col(name))


def _floor_div(number: Column, by: int) -> Column:
    """Integer quotient rounded down, also for negative numbers."""
    return ((number - F.pmod(number, F.lit(by))) / by).cast("long")


def carry_function(n: Column, m: int) -> Column:
    """What ``n`` packets do to each carried count below ``m``: entries ``(s: next count, e: windows closed)``."""
    few = F.least(n, F.lit(m)).cast("int")
    return F.array(*[F.struct(F.when(few + c >= m, 0).otherwise(few + c).cast("int").alias("s"),
                              F.when(few + c >= m, 1).otherwise(0).cast("long").alias("e")) for c in range(m)])


def _composed(children: str, m: int) -> Column:
    """One function for children in order."""
    start = F.array(*[F.struct(F.lit(c).cast("int").alias("s"), F.lit(0).cast("long").alias("e")) for c in range(m)])

    def step(acc, child):
        def through(x):
            then = F.element_at(child["f"], x["s"] + 1)
            return F.struct(then["s"].alias("s"), (x["e"] + then["e"]).alias("e"))
        return F.transform(acc, through)

    return F.aggregate(F.col(children), start, step)


def _told(children: str, s: Column, e: Column) -> Column:
    """Children in order with the count carried into them and the windows closed before them."""
    none = F.transform(F.slice(F.col(children), 1, 0),
                       lambda x: F.struct(x.alias("child"), s.alias("s"), e.alias("e")))

    def step(acc, x):
        then = F.element_at(x["f"], acc["s"] + 1)
        return F.struct(F.concat(acc["out"], F.array(F.struct(x.alias("child"), acc["s"].alias("s"), acc["e"].alias("e")))).alias("out"),
                        then["s"].alias("s"), (acc["e"] + then["e"]).alias("e"))

    return F.aggregate(F.col(children), F.struct(none.alias("out"), s.alias("s"), e.alias("e")), step, lambda acc: acc["out"])


def _levels(width: str, block: int) -> int:
    return max(1, math.ceil(math.log(SPAN_US / (pd.Timedelta(width).value / 1e3)) / math.log(block)))


def closed_before(steps: DataFrame, keys: list[str], index: str, n: str, m: int, levels: int,
                  block: int = BLOCK) -> DataFrame:
    """``steps`` with ``closed``: how many times the carried sum of ``n`` reached ``m`` before this step.

    One row per key and ``index`` (whole number, its order); after reaching ``m``
    the sum starts again at 0.  ``levels`` times ``block`` must span the indices.
    """
    payload = F.struct(*[F.col(c) for c in steps.columns])
    first = steps.select(*keys, _floor_div(F.col(index), block).alias("__b"),
                         F.struct(F.col(index).alias("i"), carry_function(F.col(n), m).alias("f"),
                                  payload.alias("row")).alias("__child"))

    def by_index(a, b):
        return F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)

    def gathered(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*keys, *by).agg(F.array_sort(F.collect_list("__child"), by_index).alias("__children"))

    tables = [gathered(first, "__b")]
    for _ in range(levels - 1):
        up = tables[-1].select(*keys, _floor_div(F.col("__b"), block).alias("__up"),
                               F.struct(F.col("__b").alias("i"), _composed("__children", m).alias("f")).alias("__child"))
        tables.append(gathered(up, "__up").withColumnRenamed("__up", "__b"))
    top = tables.pop().select(*keys, F.struct(F.col("__b").alias("i"), _composed("__children", m).alias("f"),
                                              F.col("__children").alias("below")).alias("__child"))
    # the uppermost blocks of a key are few (one, or two around the epoch)
    told = gathered(top).select(*keys, F.explode(_told("__children", F.lit(0).cast("int"), F.lit(0).cast("long"))).alias("x"))
    told = told.select(*keys, F.col("x.child.below").alias("__children"), F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    while True:
        told = told.select(*keys, F.explode(_told("__children", F.col("s"), F.col("e"))).alias("x"))
        if not tables:
            return told.select("x.child.row.*", F.col("x.e").alias("closed"))
        below = tables.pop()
        start = told.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("x.child.i").alias("__i"),
                            F.col("x.s").alias("s"), F.col("x.e").alias("e"))
        same = F.col("__b") == F.col("__i")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        told = below.join(start, same).select(*keys, "__children", "s", "e")


def _last(value: str) -> Column:
    """Latest packet's value, with its time, among rows where it is not null."""
    return F.max(F.when(F.col(value).isNotNull(), F.struct("ts", "event_id", F.col(value).alias("v"))))


def partial_windows(packets: DataFrame, width: str, keys: list[str]) -> DataFrame:
    """One mergeable row per window and key: counts, sums, means, extremes, flags, ports, last values."""
    size = F.col("size").cast("double")
    aggs = [F.count(F.lit(1)).alias("__n"), F.min("ts").alias("__first"), F.max("ts").alias("__last"),
            F.sum(size).alias("__tot"), F.avg(size).alias("__avg"), F.var_pop(size).alias("__var"),
            F.min(size).alias("__min"), F.max(size).alias("__max"), F.sum(F.col("header_len").cast("double")).alias("__hdr"),
            F.count("header_len").alias("__hdr_n"), F.count("size").alias("__size_n"),
            *[_last(c).alias(f"__last_{c}") for c in ("proto", "src_ip", "dst_ip")],
            *[F.sum(pk.flag_bit(n)).alias(f"__flag_{n}") for n in TCP_FLAG_BITS], *pk.port_indicator_aggs()]
    out = packets.groupBy(F.window("ts", width).alias("__w"), *[F.col(k).alias(f"key_{k}") for k in keys]).agg(*aggs)
    return out.select(F.col("__w.start").alias("__start"), F.col("__w.end").alias("__end"),
                      *[c for c in out.columns if c != "__w"])


def carry_over_windows(packets: DataFrame, width: str, keys: list[str] | None = None,
                       min_packets: int = MIN_WINDOW_PACKETS, block: int = BLOCK) -> DataFrame:
    """All flow features of windows that roll on until they hold ``min_packets`` packets.

    Returns ``window_first_start, window_end``, the keys as ``key_*``, ``src_ip,
    dst_ip`` and the 37 features.  Packets left over at the end of a key, too few
    to close a window, give no row; packets without a time belong to no window.
    """
    names = [f"key_{k}" for k in keys or []]
    parts = partial_windows(packets, width, list(keys or []))
    start = _micros(parts, "__start")
    grid = _micros(parts, "__end") - start
    steps = parts.withColumn("__index", ((start - F.pmod(start, grid)) / grid).cast("long"))
    steps = closed_before(steps, names, "__index", "__n", min_packets, _levels(width, block), block)
    n = F.sum("__n")
    merged = steps.groupBy(*names, "closed").agg(
        F.min("__start").alias("window_first_start"), F.max("__end").alias("window_end"), n.alias("__n"),
        F.min("__first").alias("__first"), F.max("__last").alias("__last"), F.sum("__tot").alias("__tot"),
        F.min("__min").alias("__min"), F.max("__max").alias("__max"),
        (F.sum("__hdr") / F.sum("__hdr_n")).alias("__hdr"), F.sum("__size_n").alias("__size_n"),
        # at most min_packets windows
        F.collect_list(F.struct(F.col("__size_n").alias("n"), F.col("__avg").alias("a"), F.col("__var").alias("v"))).alias("__parts"),
        *[F.max(f"__last_{c}").alias(f"__last_{c}") for c in ("proto", "src_ip", "dst_ip")],
        *[F.sum(f"__flag_{f}").alias(f"__flag_{f}") for f in TCP_FLAG_BITS],
        *[F.max(f"__port_{p}").alias(f"__port_{p}") for p in PORT_PROTOCOLS])
    merged = merged.where(F.col("__n") >= min_packets).withColumn("__avg", F.col("__tot") / F.col("__size_n"))
    # spread within the windows plus spread of their means: no difference of large squares
    spread = F.aggregate("__parts", F.lit(0.0), lambda acc, x: acc + F.when(
        x["n"] > 0, x["n"] * (x["v"] + (x["a"] - F.col("__avg")) * (x["a"] - F.col("__avg")))).otherwise(0.0))
    merged = merged.withColumn("__var", spread / F.col("__size_n")).withColumn("__std", F.sqrt("__var"))
    merged = merged.select("*", *[F.col(f"__last_{c}.v").alias(c if c != "proto" else "__proto") for c in ("proto", "src_ip", "dst_ip")])
    return merged.select("window_first_start", "window_end", *names, "src_ip", "dst_ip", *windows.feature_columns())
