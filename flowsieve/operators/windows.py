"""Packets -> fixed time windows -> the 37 flow features.

Every feature is a mergeable aggregate (count, sum, min, max, avg, population
variance, max_by), so Spark runs a partial aggregation before the shuffle and
a hot source or a hot second never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import (MIN_DURATION_SECONDS, MIN_WINDOW_PACKETS, MODEL_FEATURES,
                        PORT_PROTOCOLS, TCP_FLAG_BITS)
from ..functions import packets as pk
from . import selection

_US = 1_000_000.0


def _span_seconds(first, last):
    return F.timestamp_diff("MICROSECOND", first, last) / F.lit(_US)


def window_aggregates(capped: str | None = None) -> list:
    """Aggregates over one window of packets.

    ``capped`` names a boolean column: when given, times, sizes, header lengths
    and the packet count only use rows where it is true (the last N packets);
    flags and ports always use every packet.
    """
    def keep(c):
        return c if capped is None else F.when(F.col(capped), c)

    aggs = [
        F.count(keep(F.lit(1))).alias("__n"),
        F.min(keep(F.col("ts"))).alias("__first"),
        F.max(keep(F.col("ts"))).alias("__last"),
        F.sum(keep(F.col("size"))).cast("double").alias("__tot"),
        F.min(keep(F.col("size"))).cast("double").alias("__min"),
        F.max(keep(F.col("size"))).cast("double").alias("__max"),
        F.avg(keep(F.col("size"))).alias("__avg"),
        F.stddev_pop(keep(F.col("size"))).alias("__std"),
        F.var_pop(keep(F.col("size"))).alias("__var"),
        F.avg(keep(F.col("header_len"))).alias("__hdr"),
        pk.last_by_time("proto").alias("__proto"),
        pk.last_by_time("src_ip").alias("src_ip"),
        pk.last_by_time("dst_ip").alias("dst_ip"),
    ]
    aggs += [F.sum(pk.flag_bit(n)).alias(f"__flag_{n}") for n in TCP_FLAG_BITS]
    aggs += pk.port_indicator_aggs()
    return aggs


def feature_columns() -> list:
    """The 37 model features from the window aggregates, as doubles."""
    n = F.col("__n").cast("double")
    span = _span_seconds(F.col("__first"), F.col("__last"))
    duration = F.greatest(span, F.lit(MIN_DURATION_SECONDS))
    many = F.col("__n") > 1
    proto = F.col("__proto")
    feats = {
        "AVG": F.col("__avg"),
        "Header_Length": F.col("__hdr"),
        "IAT": F.when(many, span / (n - 1)).otherwise(F.lit(0.0)),
        "Max": F.col("__max"),
        "Min": F.col("__min"),
        "Number": n,
        "Protocol Type": proto.cast("double"),
        "Rate": n / duration,
        "Std": F.when(many, F.col("__std")).otherwise(F.lit(0.0)),
        "Tot size": F.col("__tot"),
        "Tot sum": F.col("__tot"),
        "Variance": F.when(many, F.col("__var")).otherwise(F.lit(0.0)),
    }
    feats.update(pk.protocol_indicator_map(proto, F.col("src_ip")))
    for name in PORT_PROTOCOLS:
        feats[name] = F.col(f"__port_{name}").cast("double")
    for flag in ("ack", "fin", "rst", "syn"):
        feats[f"{flag}_count"] = F.col(f"__flag_{flag}").cast("double")
    for flag in ("ack", "cwr", "ece", "fin", "psh", "rst", "syn"):
        feats[f"{flag}_flag_number"] = F.when(F.col(f"__flag_{flag}") > 0, 1.0).otherwise(0.0)
    out = []
    for name in MODEL_FEATURES:
        col = feats[name]
        out.append(col.cast("double").alias(name))
    return out


def flow_window_features(packets: DataFrame, width: str = "1 second", keys: list[str] | None = None,
                         min_packets: int = MIN_WINDOW_PACKETS, cap: int | None = None,
                         with_event: bool = False) -> DataFrame:
    """One row per (window, keys) with at least ``min_packets`` packets.

    ``keys=[]`` is one global window stream (the last packet names the source);
    ``keys=['src_ip']`` keeps one window per source, the form that scales.
    ``cap`` keeps only the last ``cap`` packets of a window for times and sizes.
    ``with_event`` adds ``event_id``, the greatest of the window's packets, as its number.
    """
    keys = list(keys or [])
    p = packets.withColumn("__w", F.window("ts", width))
    capped = None
    if cap is not None:
        # windows with more packets get the time of their cap-th newest; all others count whole
        p = p.withColumn("__gk", F.struct("__w", *keys))
        oldest = selection.kth(p, ["__gk"], ["ts", "event_id"], cap, "__oldest", descending=True)
        p = p.join(oldest, "__gk", "left").withColumn(
            "__in_cap", F.col("__oldest").isNull() | (F.struct("ts", "event_id") >= F.col("__oldest")))
        capped = "__in_cap"
    group_keys = [F.col(k).alias(f"__key_{k}") for k in keys]
    more = [F.max("event_id").alias("event_id")] if with_event else []
    agg = p.groupBy(F.col("__w"), *group_keys).agg(*window_aggregates(capped), *more)
    agg = agg.where(F.col("__n") >= min_packets)
    return agg.select(
        F.col("__w.start").alias("window_start"),
        F.col("__w.end").alias("window_end"),
        *[F.col(f"__key_{k}").alias(f"key_{k}") for k in keys],
        "src_ip", "dst_ip", *["event_id"] * with_event,
        *feature_columns(),
    )


def protocol_flags(packets: DataFrame, width: str = "1 day", keys: list[str] | None = None) -> DataFrame:
    """The 14 protocol indicators per window (port-set and protocol-number based)."""
    keys = list(keys or [])
    agg = (packets.withColumn("__w", F.window("ts", width))
           .groupBy("__w", *keys)
           .agg(pk.last_by_time("proto").alias("__proto"),
                pk.last_by_time("src_ip").alias("__src"),
                *pk.port_indicator_aggs()))
    return agg.select(
        F.col("__w.start").alias("window_start"), *keys,
        *pk.protocol_indicators(F.col("__proto"), F.col("__src")),
        *[F.col(f"__port_{n}").cast("double").alias(n) for n in PORT_PROTOCOLS],
    )


def iat_mean(packets: DataFrame, width: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """Mean gap between consecutive packets of a window.

    The mean of ``ts - lag(ts)`` telescopes to ``(last - first) / (n - 1)``,
    which is mergeable, so no per-window sort is needed.
    """
    keys = list(keys or [])
    agg = (packets.withColumn("__w", F.window("ts", width))
           .groupBy("__w", *keys)
           .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("__first"), F.max("ts").alias("__last")))
    span = _span_seconds(F.col("__first"), F.col("__last"))
    return agg.select(
        F.col("__w.start").alias("window_start"), *keys, "n",
        F.when(F.col("n") > 1, span / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("iat_mean"),
    )
