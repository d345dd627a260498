"""Scores -> decisions: safe list, ladder, repeat offenders, block acceptance, audit, counters, alerts.

A verdict row is ``event_id, ts, src_ip, dst_ip, label, confidence, n_packets``.
Per-source sequential rules are rewritten as running sums and maxima (see
``scan``), so a source holding a third of all verdicts is still spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import (ALERT_THRESHOLD, AUDIT_BENIGN_EVERY, BENIGN_LABELS,
                        BLOCK_THRESHOLD, FIREWALL_WHITELIST, MIN_PACKETS_TO_ALERT,
                        MIN_PACKETS_TO_BLOCK, MISSING_CONFIDENCE, REPEAT_ATTACK_COUNT)
from . import scan

ORDER = ["ts", "event_id"]


def is_benign(label: Column) -> Column:
    return label.isin(*BENIGN_LABELS)


def safe_list_split(verdicts: DataFrame, safe: DataFrame, src: str = "src_ip",
                    ip: str = "ip") -> tuple[DataFrame, DataFrame]:
    """(rows to score, rows skipped): anti and semi join on the source address.

    The safe list is checked before any scoring work is done on a row.
    """
    keys = safe.select(F.col(ip).alias(src)).distinct()
    return verdicts.join(keys, src, "left_anti"), verdicts.join(keys, src, "left_semi")


def ladder(df: DataFrame, alert_threshold: float = ALERT_THRESHOLD, block_threshold: float = BLOCK_THRESHOLD,
           min_alert: int = MIN_PACKETS_TO_ALERT, min_block: int = MIN_PACKETS_TO_BLOCK,
           label: str = "label", confidence: str = "confidence", n_packets: str = "n_packets") -> DataFrame:
    """BENIGN -> FP_PREVENT (low confidence or few packets) -> ALERT_ONLY -> BLOCK."""
    conf = F.coalesce(F.col(confidence), F.lit(MISSING_CONFIDENCE))
    n = F.col(n_packets)
    decision = (F.when(is_benign(F.col(label)), "BENIGN")
                .when((conf < alert_threshold) | (n < min_alert), "FP_PREVENT")
                .when((conf < block_threshold) | (n < min_block), "ALERT_ONLY")
                .otherwise("BLOCK"))
    return df.withColumn("decision", decision)


def repeat_offender(decided: DataFrame, src: str = "src_ip", order: list[str] = ORDER,
                    repeat: int = REPEAT_ATTACK_COUNT, sample_from: DataFrame | None = None,
                    alerts_before: str | None = None, running: str | None = None) -> DataFrame:
    """Alerts since the last BENIGN or BLOCK per source; every ``repeat``-th escalates to a block.

    The count restarts after an escalation, so escalation happens exactly when
    the count is a multiple of ``repeat``.  FP_PREVENT rows neither add nor reset.
    With A = running number of alerts and M = A at the latest reset row,
    the count is A - M, computed in one skew-safe scan (no per-source task).
    ``alerts_before`` names a column with the source's count before these rows;
    ``running`` names a column for the count after each row, whatever its decision.
    """
    is_alert = F.col("decision") == "ALERT_ONLY"
    is_reset = F.col("decision").isin("BENIGN", "BLOCK")
    counted = scan.count_since_reset(decided, [src], order, is_alert.cast("long"), is_reset, "__since",
                                     sample_from=sample_from,
                                     start=F.col(alerts_before) if alerts_before else None)
    out = counted.withColumn("alerts_since_reset", F.when(is_alert, F.col("__since")).otherwise(F.lit(0)))
    out = out.withColumn("escalated", is_alert & (F.col("alerts_since_reset") % repeat == 0))
    return out.withColumnRenamed("__since", running) if running else out.drop("__since")


def block_acceptance(decided: DataFrame, src: str = "src_ip", whitelist: list[str] = FIREWALL_WHITELIST,
                     blocked_before: str | None = None) -> DataFrame:
    """Whether the firewall ledger accepts each block action.

    The detector never unblocks, so the first block action of a source is
    accepted (unless whitelisted) and later ones find it already blocked.
    The first action is found by a per-source ``min`` (partial aggregation)
    joined back, not by a per-source window.  ``blocked_before`` names a column
    that says whether the source was blocked before these rows.
    """
    action = (F.col("decision") == "BLOCK") | F.col("escalated")
    tagged = decided.withColumn("block_action", action)
    firsts = (tagged.where(F.col("block_action"))
              .groupBy(F.col(src).alias("__src"))
              .agg(F.min(F.struct(*[F.col(c) for c in ORDER])).alias("__first")))
    joined = tagged.join(firsts, tagged[src] == firsts["__src"], "left")
    accepted = (F.col("block_action") & ~F.col(src).isin(*whitelist)
                & (F.struct(*[F.col(c) for c in ORDER]) == F.col("__first")))
    if blocked_before:
        accepted = accepted & ~F.coalesce(F.col(blocked_before), F.lit(False))
    return joined.withColumn("block_accepted", F.coalesce(accepted, F.lit(False))).drop("__src", "__first")


def decide(verdicts: DataFrame, safe: DataFrame | None, alerts_before: str | None = None,
           blocked_before: str | None = None, running: str | None = None, **ladder_args) -> DataFrame:
    """Full per-verdict decision table.

    Safe-listed rows are kept with ``decision = 'SAFE_LIST'`` (they are only
    counted); the rest go through the ladder, the repeat counter and the
    block ledger.
    """
    if safe is not None:
        to_score, skipped = safe_list_split(verdicts, safe)
    else:
        to_score, skipped = verdicts, verdicts.limit(0)
    # slice boundaries are sampled from the raw verdict rows (cheaper than after the join)
    counted = repeat_offender(ladder(to_score, **ladder_args), sample_from=verdicts, alerts_before=alerts_before,
                              running=running)
    scored = block_acceptance(counted, blocked_before=blocked_before)
    rest = (skipped.withColumn("decision", F.lit("SAFE_LIST"))
            .withColumn("alerts_since_reset", F.lit(0).cast("long"))
            .withColumn("escalated", F.lit(False))
            .withColumn("block_action", F.lit(False))
            .withColumn("block_accepted", F.lit(False)))
    if running:
        rest = rest.withColumn(running, F.lit(None).cast("long"))
    return scored.unionByName(rest)


def engine_counters(decided: DataFrame) -> DataFrame:
    """The engine's totals in one aggregation.

    ``total_attacks`` counts verdicts; ``attack_events`` also counts the
    second event of an escalated alert (the tool's own double count).
    """
    d = F.col("decision")
    scored = d != "SAFE_LIST"
    attack = d.isin("ALERT_ONLY", "BLOCK")

    def count(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return decided.agg(
        F.sum("n_packets").cast("long").alias("total_packets"),
        count(scored).alias("total_predictions"),
        count(attack).alias("total_attacks"),
        (count(attack) + count(F.col("escalated"))).alias("attack_events"),
        count(F.col("block_accepted")).alias("total_blocked"),
        count(d == "ALERT_ONLY").alias("total_alerts"),
        count(d == "FP_PREVENT").alias("false_positives_prevented"),
        count(d == "SAFE_LIST").alias("safe_list_skipped"),
    )


def audit_sample(decided: DataFrame, every: int = AUDIT_BENIGN_EVERY, max_lines: int | None = None,
                 sample_from: DataFrame | None = None) -> DataFrame:
    """Audit rows: every non-benign decision, benign ones whose prediction number is a
    multiple of ``every``; all of them, or the first ``max_lines`` in prediction order.

    Prediction numbers are a global running number (scan, not an
    un-partitioned window); a cut is an ordered top-k.
    ``sample_from`` (e.g. the raw verdict rows) saves re-running the decision
    pipeline just to place the scan's slice boundaries.
    """
    scored = decided.where(F.col("decision") != "SAFE_LIST")
    numbered = scan.row_number(scored, [], ORDER, "prediction_no", sample_from=sample_from)
    logged = numbered.where((F.col("decision") != "BENIGN") | (F.col("prediction_no") % every == 0))
    return logged if max_lines is None else logged.orderBy("prediction_no").limit(max_lines)


def audit_line(features: list[Column]) -> Column:
    """The log line of an audited row: time, source, label, confidence, packets, decision, then the feature values."""
    conf = percent_text(F.coalesce(F.col("confidence"), F.lit(MISSING_CONFIDENCE)))
    return F.format_string("%s | %-15s | %-30s | %6s | %4d | %-11s" + " | %8.2f" * len(features),
                           F.date_format("ts", "HH:mm:ss"), "src_ip", "label", conf, "n_packets", "decision",
                           *[f.cast("double") for f in features])


def percent_text(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100.0)


def alerts(decided: DataFrame) -> DataFrame:
    """One alert per ALERT_ONLY verdict and one per block action (an escalated alert sends both)."""
    base = [F.col("event_id"), F.col("src_ip"), F.col("dst_ip"),
            percent_text(F.coalesce(F.col("confidence"), F.lit(MISSING_CONFIDENCE))).alias("confidence_text"),
            F.col("n_packets"), F.date_format("ts", "HH:mm:ss").alias("time_text")]
    alert_rows = decided.where(F.col("decision") == "ALERT_ONLY").select(
        *base, F.lit("alert").alias("kind"), F.concat(F.col("label"), F.lit(" (alert only)")).alias("attack_type"),
        F.lit("not blocked").alias("status"))
    block_rows = decided.where(F.col("block_action")).select(
        *base, F.lit("block").alias("kind"), F.col("label").alias("attack_type"),
        F.when(F.col("block_accepted"), "blocked").otherwise("not blocked").alias("status"))
    return alert_rows.unionByName(block_rows)


def alert_json(alerts_df: DataFrame, name: str = "value") -> DataFrame:
    """Alerts with their payload as JSON text (nulls included), ready for a message sink (Kafka, files)."""
    payload = F.to_json(F.struct(*alerts_df.columns), {"ignoreNullFields": "false"})
    return alerts_df.withColumn(name, payload)
