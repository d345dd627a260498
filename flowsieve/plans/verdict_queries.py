"""Queries for decisions and ledgers: ladder, safe list, repeat offenders, audit, counters,
alerts, block ledger, address checks and the device inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..contract import BENIGN_LABELS, FIREWALL_WHITELIST, MAC_VENDORS, UNKNOWN_VENDOR
from ..operators import ledgers, verdicts
from ..session import cut_lineage, scratch_path
from ..sources import alert_sink
from .registry import r, register, sql_ts_text, sr

SAFE_DEFAULTS = ["127.0.0.1"]
_BENIGN = ", ".join(f"'{b}'" for b in BENIGN_LABELS)
_WHITE = ", ".join(f"'{w}'" for w in FIREWALL_WHITELIST)

_DECIDE_CTES = f"""
v AS (SELECT vi.*, vi.src_ip IN (SELECT ip FROM safe_list) AS is_safe FROM verdict_in vi),
lad AS (SELECT *, CASE WHEN label IN ({_BENIGN}) THEN 'BENIGN'
    WHEN coalesce(confidence, 0.5) < 0.7 OR n_packets < 5 THEN 'FP_PREVENT'
    WHEN coalesce(confidence, 0.5) < 0.95 OR n_packets < 10 THEN 'ALERT_ONLY' ELSE 'BLOCK' END AS decision
  FROM v WHERE NOT is_safe),
rep AS (SELECT *, sum(CASE WHEN decision = 'ALERT_ONLY' THEN 1 ELSE 0 END)
    OVER (PARTITION BY src_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS a FROM lad),
rep2 AS (SELECT *, max(CASE WHEN decision IN ('BENIGN', 'BLOCK') THEN a END)
    OVER (PARTITION BY src_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM rep),
esc AS (SELECT *, cast(CASE WHEN decision = 'ALERT_ONLY' THEN a - coalesce(m, 0) ELSE 0 END AS BIGINT)
    AS alerts_since_reset FROM rep2),
blk AS (SELECT *, decision = 'ALERT_ONLY' AND alerts_since_reset % 3 = 0 AS escalated FROM esc),
blk2 AS (SELECT *, decision = 'BLOCK' OR escalated AS block_action FROM blk),
firsts AS (SELECT src_ip, min({{'t': ts, 'e': event_id}}) AS f FROM blk2 WHERE block_action GROUP BY src_ip),
acc AS (SELECT b.*, coalesce(b.block_action AND b.src_ip NOT IN ({_WHITE})
    AND {{'t': b.ts, 'e': b.event_id}} = f.f, false) AS block_accepted
  FROM blk2 b LEFT JOIN firsts f ON b.src_ip = f.src_ip),
decided AS (
  SELECT event_id, ts, src_ip, dst_ip, label, confidence, n_packets, decision, alerts_since_reset, escalated,
         block_action, block_accepted FROM acc
  UNION ALL
  SELECT event_id, ts, src_ip, dst_ip, label, confidence, n_packets, 'SAFE_LIST', 0, false, false, false
  FROM v WHERE is_safe)"""


def _decide_sql(body: str) -> str:
    head = fx.with_ctes("SELECT 1", "verdict_in", "safe_list")[:-len("\nSELECT 1")]
    return head + "," + _DECIDE_CTES + "\n" + body


def decided(spark, sf_dir):
    return verdicts.decide(fx.load(spark, sf_dir, "verdict_in"), fx.load(spark, sf_dir, "safe_list"))


@register("benign_predicate", fx.with_ctes(
    f"SELECT event_id, label, label IN ({_BENIGN}) AS is_benign FROM verdict_in", "verdict_in"))
def q_benign_predicate(spark, sf_dir):
    v = fx.load(spark, sf_dir, "verdict_in")
    return v.select("event_id", "label", verdicts.is_benign(F.col("label")).alias("is_benign"))


@register("safe_list_split", _decide_sql("SELECT event_id, src_ip FROM v WHERE NOT is_safe"))
def q_safe_list_split(spark, sf_dir):
    to_score, _ = verdicts.safe_list_split(fx.load(spark, sf_dir, "verdict_in"), fx.load(spark, sf_dir, "safe_list"))
    return to_score.select("event_id", "src_ip")


@register("verdict_ladder", _decide_sql("SELECT event_id, src_ip, decision FROM lad"))
def q_verdict_ladder(spark, sf_dir):
    to_score, _ = verdicts.safe_list_split(fx.load(spark, sf_dir, "verdict_in"), fx.load(spark, sf_dir, "safe_list"))
    return verdicts.ladder(to_score).select("event_id", "src_ip", "decision")


@register("repeat_offender", _decide_sql(
    "SELECT event_id, src_ip, decision, alerts_since_reset, escalated FROM decided WHERE decision <> 'SAFE_LIST'"))
def q_repeat_offender(spark, sf_dir):
    d = decided(spark, sf_dir).where(F.col("decision") != "SAFE_LIST")
    return d.select("event_id", "src_ip", "decision", "alerts_since_reset", "escalated")


_COUNTER_SQL = """SELECT cast(sum(n_packets) AS BIGINT) AS total_packets,
  cast(sum(CASE WHEN decision <> 'SAFE_LIST' THEN 1 ELSE 0 END) AS BIGINT) AS total_predictions,
  cast(sum(CASE WHEN decision IN ('ALERT_ONLY', 'BLOCK') THEN 1 ELSE 0 END) AS BIGINT) AS total_attacks,
  cast(sum(CASE WHEN decision IN ('ALERT_ONLY', 'BLOCK') THEN 1 ELSE 0 END)
       + sum(CASE WHEN escalated THEN 1 ELSE 0 END) AS BIGINT) AS attack_events,
  cast(sum(CASE WHEN block_accepted THEN 1 ELSE 0 END) AS BIGINT) AS total_blocked,
  cast(sum(CASE WHEN decision = 'ALERT_ONLY' THEN 1 ELSE 0 END) AS BIGINT) AS total_alerts,
  cast(sum(CASE WHEN decision = 'FP_PREVENT' THEN 1 ELSE 0 END) AS BIGINT) AS false_positives_prevented,
  cast(sum(CASE WHEN decision = 'SAFE_LIST' THEN 1 ELSE 0 END) AS BIGINT) AS safe_list_skipped
FROM decided"""


@register("engine_counters", _decide_sql(_COUNTER_SQL))
def q_engine_counters(spark, sf_dir):
    return verdicts.engine_counters(decided(spark, sf_dir))


@register("audit_sample", _decide_sql(
    f"SELECT prediction_no, event_id, src_ip, label, n_packets, decision, escalated, {sr('confidence')} AS confidence, "
    "printf('%s | %-15s | %-30s | %6s | %4d | %-11s | %8.2f', strftime(ts, '%H:%M:%S'), src_ip, label, "
    "printf('%.1f%%', coalesce(confidence, 0.5) * 100.0), n_packets, decision, cast(n_packets AS double)) AS line FROM ("
    "SELECT *, row_number() OVER (ORDER BY ts, event_id) AS prediction_no FROM decided "
    "WHERE decision <> 'SAFE_LIST') AS n WHERE decision <> 'BENIGN' OR prediction_no % 10 = 0"))
def q_audit_sample(spark, sf_dir):
    out = verdicts.audit_sample(decided(spark, sf_dir), sample_from=fx.load(spark, sf_dir, "verdict_in"))
    return out.select("prediction_no", "event_id", "src_ip", "label", "n_packets", "decision", "escalated",
                      r("confidence").alias("confidence"), verdicts.audit_line([F.col("n_packets")]).alias("line"))


_ALERT_SQL = """SELECT *, to_json({event_id: event_id, src_ip: src_ip, dst_ip: dst_ip, confidence_text: confidence_text,
  n_packets: n_packets, time_text: time_text, kind: kind, attack_type: attack_type, status: status}) AS payload FROM (
SELECT event_id, src_ip, dst_ip, printf('%.1f%%', coalesce(confidence, 0.5) * 100.0) AS confidence_text,
  n_packets, strftime(ts, '%H:%M:%S') AS time_text, 'alert' AS kind, label || ' (alert only)' AS attack_type,
  'not blocked' AS status FROM decided WHERE decision = 'ALERT_ONLY' UNION ALL
SELECT event_id, src_ip, dst_ip, printf('%.1f%%', coalesce(confidence, 0.5) * 100.0), n_packets,
  strftime(ts, '%H:%M:%S'), 'block', label, CASE WHEN block_accepted THEN 'blocked' ELSE 'not blocked' END
  FROM decided WHERE block_action) AS a"""


@register("sink_alerts", _decide_sql(_ALERT_SQL))
def q_sink_alerts(spark, sf_dir):
    """Alerts written by the alert sink, one transaction sent twice, and read back with their payloads."""
    sink, path = alert_sink.register(spark), scratch_path(spark, "alerts")
    rows = verdicts.alerts(decided(spark, sf_dir))
    rows = cut_lineage(rows)
    for _ in range(2):  # the second try of a transaction adds nothing
        rows.write.format(sink).option("path", path).option("transaction", "1").mode("append").save()
    return verdicts.alert_json(spark.read.format(sink).load(path), "payload")


# -- ledgers ------------------------------------------------------------------

_LEDGER_SQL = """SELECT event_id, ip, op, CASE WHEN op = 'block' THEN coalesce(prev <> 'block', true)
    ELSE coalesce(prev = 'block', false) END AS success FROM (
  SELECT *, lag(op) OVER (PARTITION BY ip ORDER BY ts, event_id) AS prev FROM command_log
  WHERE op IN ('block', 'unblock') AND NOT (op = 'block' AND coalesce(whitelisted, false))) AS e
UNION ALL SELECT event_id, ip, op, false FROM command_log WHERE op = 'block' AND coalesce(whitelisted, false)"""


@register("block_ledger", fx.with_ctes(_LEDGER_SQL, "command_log"))
def q_block_ledger(spark, sf_dir):
    judged = ledgers.block_ledger(fx.load(spark, sf_dir, "command_log"))
    return judged.select("event_id", "ip", "op", "success")


@register("blocked_list", fx.with_ctes(
    f"SELECT ip, {sql_ts_text('blocked_at')} AS blocked_at, attack_type FROM ("
    "SELECT ip, arg_max(op, {'t': ts, 'e': event_id}) AS last_op, "
    "max(CASE WHEN op = 'block' AND success THEN {'t': ts, 'e': event_id, 'a': attack_type} END) AS o "
    f"FROM (SELECT j.*, c.ts, c.attack_type FROM ({_LEDGER_SQL}) AS j JOIN command_log c USING (event_id) "
    "WHERE NOT (j.op = 'block' AND coalesce(c.whitelisted, false))) AS x GROUP BY ip) AS g, "
    "LATERAL (SELECT o.t AS blocked_at, o.a AS attack_type) AS l WHERE last_op = 'block'", "command_log"))
def q_blocked_list(spark, sf_dir):
    judged = ledgers.block_ledger(fx.load(spark, sf_dir, "command_log"))
    out = ledgers.blocked_list(judged)
    from .registry import ts_text
    return out.withColumn("blocked_at", ts_text("blocked_at"))


def _valid_sql(e: str) -> str:
    return (f"coalesce(len(string_split({e}, '.')) = 4 AND list_bool_and(list_transform(string_split({e}, '.'), "
            "lambda x: coalesce(TRY_CAST(x AS INTEGER) BETWEEN 0 AND 255, false))), false)")


@register("safe_list_apply", fx.with_ctes(
    "SELECT ip FROM (SELECT ip, arg_max(op, {'t': ts, 'e': event_id}) AS last_op FROM command_log "
    f"WHERE (op = 'add' AND {_valid_sql('ip')}) OR op = 'remove' GROUP BY ip) AS g WHERE last_op = 'add' "
    "UNION SELECT d FROM (VALUES " + ", ".join(f"('{d}')" for d in SAFE_DEFAULTS) + ") AS t(d) "
    "WHERE d NOT IN (SELECT ip FROM command_log WHERE op IN ('add', 'remove'))", "command_log"))
def q_safe_list_apply(spark, sf_dir):
    return ledgers.safe_list_apply(fx.load(spark, sf_dir, "command_log"), SAFE_DEFAULTS)


_IP_VALUES = [
    ("src_ip", "src_ip"),
    ("dst_ip", "dst_ip"),
    ("five_parts", "concat(src_ip, '.', cast(k AS string))"),
    ("big_octet", "concat(cast(k + 200 AS string), '.', dst_ip)"),
    ("short", "concat(cast(k AS string), '.', cast(user_id AS string))"),
    ("text_part", "concat('10.', event_type, '.0.1')"),
]


def _ip_values_sql() -> str:
    parts = [f"SELECT event_id, '{n}' AS kind, {e} AS value FROM packets JOIN (SELECT event_id, event_type FROM events) AS ev USING (event_id)"
             for n, e in _IP_VALUES]
    body = "SELECT event_id, kind, value, " + _valid_sql("value") + " AS valid FROM (" + " UNION ALL ".join(parts) + ") AS x"
    return fx.with_ctes(body, "packets")


@register("ipv4_valid", _ip_values_sql())
def q_ipv4_valid(spark, sf_dir):
    from ..sources.tables import table
    packets = fx.PROJECTIONS["packets"].columns
    p = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in packets], "event_type")
    kinds = ", ".join(f"struct('{n}' AS kind, {e} AS value)" for n, e in _IP_VALUES)
    vals = p.selectExpr("event_id", f"inline(array({kinds}))")  # every address of a row from one scan
    return vals.withColumn("valid", ledgers.ipv4_valid(F.col("value")))


_VENDOR_CASE = ("CASE substr(upper(replace(mac, '-', ':')), 1, 8) "
                + " ".join(f"WHEN '{p}' THEN '{v}'" for p, v in MAC_VENDORS)
                + f" ELSE '{UNKNOWN_VENDOR}' END")


@register("oui_vendor", fx.with_ctes(
    f"SELECT seen_order, upper(replace(mac, '-', ':')) AS mac, {_VENDOR_CASE} AS vendor FROM arp", "arp"))
def q_oui_vendor(spark, sf_dir):
    arp = fx.load(spark, sf_dir, "arp")
    return arp.select("seen_order", ledgers.normalize_mac(F.col("mac")).alias("mac"),
                      ledgers.oui_vendor(F.col("mac")).alias("vendor"))


_DEDUP_SQL = ("SELECT mac, seen_order, ip, subnet FROM (SELECT upper(replace(mac, '-', ':')) AS mac, seen_order, ip, "
              "subnet, row_number() OVER (PARTITION BY upper(replace(mac, '-', ':')) ORDER BY seen_order) AS rn "
              "FROM arp) AS d WHERE rn = 1")


@register("device_dedup", fx.with_ctes(_DEDUP_SQL, "arp"))
def q_device_dedup(spark, sf_dir):
    return ledgers.device_dedup(fx.load(spark, sf_dir, "arp")).select("mac", "seen_order", "ip", "subnet")


_RANK_SQL = ("row_number() OVER (ORDER BY cast(split_part(ip, '.', 1) AS INTEGER), cast(split_part(ip, '.', 2) AS "
             "INTEGER), cast(split_part(ip, '.', 3) AS INTEGER), cast(split_part(ip, '.', 4) AS INTEGER), seen_order)")


@register("sort_by_ip", fx.with_ctes(f"SELECT ip, mac, {_RANK_SQL} AS ip_rank FROM ({_DEDUP_SQL}) AS d", "arp"))
def q_sort_by_ip(spark, sf_dir):
    return ledgers.sort_by_ip(ledgers.device_dedup(fx.load(spark, sf_dir, "arp"))).select("ip", "mac", "ip_rank")


@register("device_inventory", fx.with_ctes(
    f"SELECT ip_rank, ip, mac, vendor, subnet, subnet_devices FROM (SELECT ip, mac, subnet, {_RANK_SQL} AS ip_rank, "
    f"{_VENDOR_CASE} AS vendor, count(*) OVER (PARTITION BY subnet) AS subnet_devices FROM ({_DEDUP_SQL}) AS d) AS x",
    "arp"))
def q_device_inventory(spark, sf_dir):
    inv = ledgers.device_inventory(fx.load(spark, sf_dir, "arp"))
    return inv.select("ip_rank", "ip", "mac", "vendor", "subnet", "subnet_devices")
