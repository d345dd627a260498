"""Decisions over a stream of scored windows: safe list, ladder, repeat offenders, block ledger, totals.

A micro-batch is decided with the same operators as a table (``operators.verdicts``),
which deal a source with a third of all rows over many tasks; what a source has
done before the batch is one row of a versioned state table, its alerts since the
last reset and whether it is blocked.

Rows must be judged in event time, but files may arrive out of order.  So a batch
holds rows back until the watermark, the latest event time seen minus ``delay``,
has passed them, then judges all that are due in order of time and event number.
Rows that arrive behind the watermark cannot be judged any more; they are kept in
the table ``late``.  ``decided`` and ``totals`` can include what is still held back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verdicts
from .store import BatchStore

STATE = "src_ip string, alerts long, blocked boolean"
#: Added to an input row by a decision.
DECISION = ("decision string, alerts_since_reset long, escalated boolean, block_action boolean, "
            "block_accepted boolean, running_alerts long")
TOTALS = ("total_packets", "total_predictions", "total_attacks", "attack_events", "total_blocked", "total_alerts",
          "false_positives_prevented", "safe_list_skipped")


class VerdictStream:
    """Decisions kept under ``root``; one instance per run, the tables carry everything over a restart."""

    def __init__(self, spark: SparkSession, root: str, safe: DataFrame, delay: str, **ladder):
        self.spark, self.safe, self.ladder = spark, safe, ladder
        self.delay = pd.Timedelta(delay).value // 1000
        self.store = BatchStore(spark, root)

    def _judged(self, rows: DataFrame) -> DataFrame:
        """All rows with their decisions, given the committed state of their sources."""
        state = self.store.state("sources", _schema(self.spark, STATE), ["src_ip"])
        before = state.select(F.col("src_ip").alias("__src"), F.col("alerts").alias("alerts_before"),
                              F.col("blocked").alias("blocked_before"))
        known = rows.join(before, F.col("src_ip").eqNullSafe(F.col("__src")), "left").drop("__src")
        return verdicts.decide(known, self.safe, alerts_before="alerts_before", blocked_before="blocked_before",
                               running="running_alerts", **self.ladder)

    def apply(self, batch: DataFrame, number: int) -> None:
        """What ``foreachBatch`` calls."""
        if self.store.done(number):
            return
        head = self.store.head() or {}
        passed, schema = head.get("watermark"), batch.schema
        rows = batch
        if passed is not None:
            late = F.unix_micros(F.col("ts").cast("timestamp")) <= passed
            self.store.write("late", batch.where(late), number)
            held = self.store.read("held", schema, head["batch"])
            rows = batch.where(F.coalesce(~late, F.lit(True))).unionByName(held)
        latest = batch.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t")).first()["t"]
        mark = max((x for x in (passed, None if latest is None else latest - self.delay) if x is not None), default=None)
        due = F.lit(False) if mark is None else F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) <= mark, F.lit(False))
        self.store.write("held", rows.where(~due), number)
        done = self.store.write("decided", self._judged(rows.where(due)), number)
        scored = done.where(F.col("decision") != "SAFE_LIST")
        changed = scored.groupBy("src_ip").agg(
            F.max_by("running_alerts", F.struct(*verdicts.ORDER)).alias("alerts"),
            F.max(F.col("block_accepted") | F.coalesce("blocked_before", F.lit(False))).alias("blocked"))
        bases = self.store.change("sources", changed, ["src_ip"], number)
        self.store.write("totals", verdicts.engine_counters(done), number)
        self.before_commit(number)
        self.store.commit(number, watermark=mark, bases=bases)

    def before_commit(self, number: int) -> None:
        """Called when a batch is written but not yet valid; further sinks of the batch go here."""

    def batch_decisions(self, schema, number: int) -> DataFrame:
        """Decisions that batch ``number`` has written, committed or not."""
        return self.spark.read.schema(_decided(self.spark, schema)).parquet(self.store.folder("decided", number))

    def decided(self, schema, flush: bool = True) -> DataFrame:
        """All decisions so far; with ``flush`` also of the rows that are still held back, as if nothing came before them."""
        done = self.store.read("decided", _decided(self.spark, schema))
        head = self.store.head()
        if not flush or head is None:
            return done
        return done.unionByName(self._judged(self.store.read("held", schema, head["batch"])).select(*done.columns))

    def late(self, schema) -> DataFrame:
        return self.store.read("late", schema)

    def totals(self, schema, flush: bool = True) -> DataFrame:
        """Live totals: one row per batch is summed; what a batch does again on a second try counts once."""
        whole = _schema(self.spark, ", ".join(f"{c} long" for c in TOTALS))
        parts = self.store.read("totals", whole)
        head = self.store.head()
        if flush and head is not None:
            parts = parts.unionByName(verdicts.engine_counters(self._judged(self.store.read("held", schema, head["batch"]))))
        return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOTALS])


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def _decided(spark: SparkSession, schema):
    """Columns of a decision table over rows of ``schema``."""
    more = _schema(spark, "alerts_before long, blocked_before boolean, " + DECISION)
    out = type(schema)(list(schema.fields))
    for f in more.fields:
        out = out.add(f)
    return out
