"""Queries over the packet stream: windows, flags, layer fields, protocol indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..contract import MODEL_FEATURES, PORT_PROTOCOLS, TCP_FLAG_BITS
from ..functions import packets as pk
from ..operators import windows
from .registry import r, register, sql_ts_text, sr, ts_text

# Test-table widths (the tool's 1-second window is a parameter; see FIXTURES).
GLOBAL_WIDTH = "1 hour"
SOURCE_WIDTH = "1 day"
TEST_CAP = 5

# DuckDB ordering key "latest packet": time, then event id.
_LAST = "{'t': ts, 'e': event_id}"

_INT_FEATURES = {"Number", "Max", "Min", "Tot size", "Tot sum", "Protocol Type", "ARP", "ICMP", "TCP", "UDP", "IPv", "LLC",
                 "ack_count", "fin_count", "rst_count", "syn_count"} | set(PORT_PROTOCOLS) | {
    f"{f}_flag_number" for f in ("ack", "cwr", "ece", "fin", "psh", "rst", "syn")}


def _window_out(df, keys, more=()):
    cols = [ts_text("window_start").alias("window_start"), *more]
    cols += [F.col(f"key_{k}") for k in keys]
    cols += ["src_ip", "dst_ip"]
    cols += [F.col(f"`{n}`") if n in _INT_FEATURES else r(F.col(f"`{n}`")).alias(n)
             for n in MODEL_FEATURES]
    return df.select(*cols)


def _window_sql(width_unit: str, keys: list[str], cap: int | None = None, closed_only: bool = False) -> str:
    """Oracle for the 37 window features (global or per key)."""
    return fx.with_ctes(window_body(width_unit, keys, cap, closed_only), "packets")


def window_body(width_unit: str, keys: list[str], cap: int | None = None, closed_only: bool = False,
                source: str | None = None) -> str:
    """Features per window ``w`` of ``source`` (packets with ``w`` and ``rk``, the rank from the window's end)."""
    q = fx.q_sql
    key_sel = "".join(f", {k} AS key_{k}" for k in keys)
    key_grp = "".join(f", {k}" for k in keys)
    part = ", ".join(["w", *keys])
    cap_filter = "TRUE" if cap is None else f"rk <= {cap}"
    ports = {n: " OR ".join(
        [f"(proto IN (6, 17) AND (sport IN ({', '.join(map(str, p))}) OR dport IN ({', '.join(map(str, p))})))"])
        for n, p in PORT_PROTOCOLS.items()}
    flag = {n: f"sum(CASE WHEN proto = 6 AND (flags & {b}) > 0 THEN 1 ELSE 0 END)" for n, b in TCP_FLAG_BITS.items()}
    keep = lambda e: f"CASE WHEN {cap_filter} THEN {e} END"
    source = source or (f"SELECT *, date_trunc('{width_unit}', ts) AS w, row_number() OVER (PARTITION BY {part} "
                        "ORDER BY ts DESC, event_id DESC) AS rk FROM packets")
    # a stream emits a window once the watermark (latest event time) has passed its end
    closed = (f" AND w + INTERVAL 1 {width_unit} <= (SELECT max(ts) FROM packets)" if closed_only else "")
    agg = f"""
      SELECT w{key_grp},
        count({keep('1')}) AS n,
        (epoch_us(max({keep('ts')})) - epoch_us(min({keep('ts')}))) / 1000000.0 AS span,
        sum({keep('size')}) AS tot, min({keep('size')}) AS mn, max({keep('size')}) AS mx,
        avg({keep('size')}) AS av, stddev_pop({keep('size')}) AS sd, var_pop({keep('size')}) AS vr,
        avg({keep('header_len')}) AS hdr,
        arg_max(proto, CASE WHEN proto IS NOT NULL THEN {_LAST} END) AS proto_last,
        arg_max(src_ip, CASE WHEN src_ip IS NOT NULL THEN {_LAST} END) AS src_ip,
        arg_max(dst_ip, CASE WHEN dst_ip IS NOT NULL THEN {_LAST} END) AS dst_ip,
        {', '.join(f'{e} AS f_{n}' for n, e in flag.items())},
        {', '.join(f'max(CASE WHEN {e} THEN 1 ELSE 0 END) AS p_{n}' for n, e in ports.items())}
      FROM ({source}) AS p
      GROUP BY w{key_grp}
      HAVING count({keep('1')}) >= 3{closed}"""
    feats = {
        "AVG": sr("av"),
        "Header_Length": sr("hdr"),
        "IAT": sr("CASE WHEN n > 1 THEN span / (n - 1) ELSE 0.0 END"),
        "Max": "cast(mx AS double)",
        "Min": "cast(mn AS double)",
        "Number": "cast(n AS double)",
        "Protocol Type": "cast(proto_last AS double)",
        "Rate": sr("n / greatest(span, 0.001)"),
        "Std": sr("CASE WHEN n > 1 THEN sd ELSE 0.0 END"),
        "Tot size": "cast(tot AS double)",
        "Tot sum": "cast(tot AS double)",
        "Variance": sr("CASE WHEN n > 1 THEN vr ELSE 0.0 END"),
        "ARP": "CASE WHEN proto_last = 0 AND src_ip IS NOT NULL THEN 1.0 ELSE 0.0 END",
        "ICMP": "CASE WHEN proto_last = 1 THEN 1.0 ELSE 0.0 END",
        "TCP": "CASE WHEN proto_last = 6 THEN 1.0 ELSE 0.0 END",
        "UDP": "CASE WHEN proto_last = 17 THEN 1.0 ELSE 0.0 END",
        "IPv": "CASE WHEN proto_last IN (6, 17, 1, 2, 47) THEN 1.0 ELSE 0.0 END",
        "LLC": "0.0",
    }
    for n in PORT_PROTOCOLS:
        feats[n] = f"cast(p_{n} AS double)"
    for f in ("ack", "fin", "rst", "syn"):
        feats[f"{f}_count"] = f"cast(f_{f} AS double)"
    for f in ("ack", "cwr", "ece", "fin", "psh", "rst", "syn"):
        feats[f"{f}_flag_number"] = f"CASE WHEN f_{f} > 0 THEN 1.0 ELSE 0.0 END"
    sel = ", ".join(f"cast({feats[n]} AS double) AS {q(n)}" for n in MODEL_FEATURES)
    keys_out = "".join(f", key_{k}" for k in keys)
    return (f"SELECT {sql_ts_text('w')} AS window_start{keys_out}, src_ip, dst_ip, {sel} "
            f"FROM ({agg.replace('SELECT w' + key_grp, 'SELECT w' + key_sel, 1)}) AS a")


@register("flow_window_features", _window_sql("hour", []))
def q_flow_window_features(spark, sf_dir):
    packets = fx.load(spark, sf_dir, "packets")
    return _window_out(windows.flow_window_features(packets, GLOBAL_WIDTH), [])


@register("flow_window_features_by_source", _window_sql("day", ["src_ip"]))
def q_flow_window_features_by_source(spark, sf_dir):
    packets = fx.load(spark, sf_dir, "packets")
    return _window_out(windows.flow_window_features(packets, SOURCE_WIDTH, keys=["src_ip"]), ["src_ip"])


@register("window_cap", _window_sql("hour", [], cap=TEST_CAP))
def q_window_cap(spark, sf_dir):
    packets = fx.load(spark, sf_dir, "packets")
    return _window_out(windows.flow_window_features(packets, GLOBAL_WIDTH, cap=TEST_CAP), [])


_FLAG_SQL = ", ".join(f"CASE WHEN (flags & {b}) > 0 THEN 1 ELSE 0 END AS {n}" for n, b in TCP_FLAG_BITS.items())


@register("tcp_flag_bits", fx.with_ctes(f"SELECT event_id, {_FLAG_SQL} FROM packets WHERE proto = 6", "packets"))
def q_tcp_flag_bits(spark, sf_dir):
    packets = fx.load(spark, sf_dir, "packets")
    return packets.where(pk.is_tcp()).select("event_id", *pk.tcp_flag_columns())


@register("packet_layer_fields", fx.with_ctes(
    "SELECT event_id, CASE WHEN proto = 0 THEN 'ARP' WHEN proto IS NOT NULL THEN 'IP' ELSE 'OTHER' END AS layer, "
    "CASE WHEN proto = 0 THEN 28 WHEN proto IS NOT NULL THEN header_len ELSE 14 END AS hdr_len, "
    "CASE WHEN proto = 0 THEN 0 ELSE proto END AS proto FROM packets", "packets"))
def q_packet_layer_fields(spark, sf_dir):
    packets = fx.load(spark, sf_dir, "packets")
    return packets.select(
        "event_id", pk.layer().alias("layer"), pk.layer_header_len().alias("hdr_len"),
        F.when(F.col("proto") == 0, F.lit(0)).otherwise(F.col("proto")).alias("proto"))


def _protocol_flags_sql() -> str:
    ports = ", ".join(
        f"cast(max(CASE WHEN proto IN (6, 17) AND (sport IN ({', '.join(map(str, p))}) "
        f"OR dport IN ({', '.join(map(str, p))})) THEN 1 ELSE 0 END) AS double) AS {n}"
        for n, p in PORT_PROTOCOLS.items())
    body = f"""
    SELECT {sql_ts_text('w')} AS window_start, src_ip,
      CASE WHEN pl = 0 AND sl IS NOT NULL THEN 1.0 ELSE 0.0 END AS ARP,
      CASE WHEN pl = 1 THEN 1.0 ELSE 0.0 END AS ICMP,
      CASE WHEN pl = 6 THEN 1.0 ELSE 0.0 END AS TCP,
      CASE WHEN pl = 17 THEN 1.0 ELSE 0.0 END AS UDP,
      CASE WHEN pl IN (6, 17, 1, 2, 47) THEN 1.0 ELSE 0.0 END AS IPv,
      0.0 AS LLC, {', '.join(PORT_PROTOCOLS)}
    FROM (SELECT date_trunc('day', ts) AS w, src_ip,
            arg_max(proto, CASE WHEN proto IS NOT NULL THEN {_LAST} END) AS pl,
            arg_max(src_ip, {_LAST}) AS sl, {ports}
          FROM packets GROUP BY 1, 2) AS a"""
    return fx.with_ctes(body, "packets")


@register("protocol_flags", _protocol_flags_sql())
def q_protocol_flags(spark, sf_dir):
    packets = fx.load(spark, sf_dir, "packets")
    out = windows.protocol_flags(packets, SOURCE_WIDTH, keys=["src_ip"])
    return out.withColumn("window_start", ts_text("window_start"))


@register("iat_mean", fx.with_ctes(
    f"SELECT {sql_ts_text('w')} AS window_start, n, {sr('CASE WHEN n > 1 THEN span / (n - 1) ELSE 0.0 END')} AS iat_mean "
    "FROM (SELECT date_trunc('hour', ts) AS w, count(*) AS n, "
    "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS span FROM packets GROUP BY 1) AS a", "packets"))
def q_iat_mean(spark, sf_dir):
    packets = fx.load(spark, sf_dir, "packets")
    out = windows.iat_mean(packets, GLOBAL_WIDTH)
    return out.select(ts_text("window_start").alias("window_start"), "n", r("iat_mean").alias("iat_mean"))
