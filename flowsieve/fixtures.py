"""Deterministic projections of the driver's test tables into this library's inputs.

Each projection is a list of ``(column, expression)`` pairs whose expressions
mean the same thing in Spark SQL and in DuckDB, so one definition feeds both
the Spark job (``selectExpr``) and the SQL oracle (a CTE).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import table


def q_spark(name: str) -> str:
    return f"`{name}`"


def q_sql(name: str) -> str:
    return '"' + name + '"'


def _dbl(expr: str) -> str:
    return f"cast({expr} as double)"


FLOW_LABEL = (
    "case when l_partkey % 4 = 0 and l_extendedprice / 20 > 2500 then 'DDOS-SYN_FLOOD' "
    "when l_partkey % 4 = 0 and l_extendedprice / 20 > 1500 then 'DOS-SYN_FLOOD' "
    "when l_partkey % 4 = 1 and l_extendedprice / 20 > 2500 then 'DDOS-UDP_FLOOD' "
    "when l_partkey % 4 = 1 and l_extendedprice / 20 > 1500 then 'MIRAI-UDPPLAIN' "
    "when l_partkey % 4 = 2 and l_extendedprice / 20 > 1500 then 'DDOS-ICMP_FLOOD' "
    "when l_partkey % 4 = 3 and l_quantity < 5 then 'MITM-ARPSPOOFING' "
    "when l_partkey % 17 = 0 then 'DICTIONARYBRUTEFORCE' "
    "when l_partkey % 7 = 0 and l_quantity < 3 then 'XSS' "
    "when l_suppkey % 50 = 0 then 'UnknownTool' else 'BENIGN' end"
)

FLOW_NUMERIC = [
    ("file_id", "l_suppkey % 10"),
    ("ARP", "case when l_partkey % 4 = 3 then 1.0 else 0.0 end"),
    ("AVG", "40.0 + l_partkey % 20 + 5 * l_quantity"),
    ("DHCP", "case when l_partkey % 31 = 0 then 1.0 else 0.0 end"),
    ("DNS", "case when l_partkey % 13 = 0 then 1.0 else 0.0 end"),
    ("HTTP", "case when l_partkey % 7 = 0 then 1.0 else 0.0 end"),
    ("HTTPS", "case when l_partkey % 11 = 0 then 1.0 else 0.0 end"),
    ("Header_Length", "20.0 + 4 * (l_partkey % 5)"),
    ("IAT", "l_tax"),
    ("ICMP", "case when l_partkey % 4 = 2 then 1.0 else 0.0 end"),
    ("IPv", "case when l_partkey % 4 = 3 then 0.0 else 1.0 end"),
    ("IRC", "case when l_partkey % 29 = 0 then 1.0 else 0.0 end"),
    ("LLC", "0.0"),
    ("Max", "40.0 + l_partkey % 20 + 10 * l_quantity"),
    ("Min", "40.0 + l_partkey % 20"),
    ("Number", "l_quantity"),
    ("Protocol Type", "case l_partkey % 4 when 0 then 6.0 when 1 then 17.0 when 2 then 1.0 else 0.0 end"),
    ("Rate", "l_extendedprice / 20"),
    ("SMTP", "case when l_partkey % 23 = 0 then 1.0 else 0.0 end"),
    ("SSH", "case when l_partkey % 17 = 0 then 1.0 else 0.0 end"),
    ("Std", "2.5 * l_quantity"),
    ("TCP", "case when l_partkey % 4 = 0 then 1.0 else 0.0 end"),
    ("Telnet", "case when l_partkey % 19 = 0 then 1.0 else 0.0 end"),
    ("Tot size", "l_extendedprice"),
    ("Tot sum", "l_extendedprice"),
    ("UDP", "case when l_partkey % 4 = 1 then 1.0 else 0.0 end"),
    ("Variance", "6.25 * l_quantity * l_quantity"),
    ("ack_count", "l_orderkey % 6"),
    ("ack_flag_number", "case when l_orderkey % 6 > 0 then 1.0 else 0.0 end"),
    ("cwr_flag_number", "case when l_orderkey % 101 = 0 then 1.0 else 0.0 end"),
    ("ece_flag_number", "case when l_orderkey % 97 = 0 then 1.0 else 0.0 end"),
    ("fin_count", "l_linenumber % 3"),
    ("fin_flag_number", "case when l_linenumber % 3 > 0 then 1.0 else 0.0 end"),
    ("psh_flag_number", "case when l_orderkey % 5 = 0 then 1.0 else 0.0 end"),
    ("rst_count", "l_suppkey % 3"),
    ("rst_flag_number", "case when l_suppkey % 3 > 0 then 1.0 else 0.0 end"),
    ("syn_count", "l_linenumber"),
    ("syn_flag_number", "case when l_linenumber > 0 then 1.0 else 0.0 end"),
]

FLOWS = [(n, _dbl(e)) for n, e in FLOW_NUMERIC] + [("label", FLOW_LABEL)]

DIRTY_RATE = (
    "case l_orderkey % 1000 when 0 then cast('Infinity' as double) "
    "when 1 then cast('-Infinity' as double) when 2 then cast('NaN' as double) "
    "when 3 then null else l_extendedprice / 20 end"
)
FLOWS_DIRTY = [(n, _dbl(DIRTY_RATE) if n == "Rate" else e) for n, e in FLOWS]

EV_LABEL = (
    "case event_type when 'signup' then 'DDOS-SYN_FLOOD' when 'click' then 'BENIGN' "
    "when 'purchase' then 'DOS-SYN_FLOOD' when 'error' then 'MIRAI-UDPPLAIN' else 'XSS' end"
)
FLOWS_EV = [
    ("row_key", "event_id"),
    ("file_id", "event_id % 10"),
    ("x", "value"),
    ("label", EV_LABEL),
]

K_EXPR = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
IP_OF_USER = (
    "concat('10.0.', cast(cast(floor(user_id / 256) as int) as string), '.', "
    "cast(user_id % 256 as string))"
)

PACKETS = [
    ("event_id", "event_id"),
    ("ts", "ts"),
    ("src_ip", IP_OF_USER),
    ("dst_ip", "concat('192.168.1.', cast(event_id % 254 + 1 as string))"),
    ("proto", "case when event_id % 10 = 0 then 1 when event_id % 10 in (1, 2) then 17 "
              "when event_id % 10 = 3 then 0 else 6 end"),
    ("header_len", "case when event_id % 10 = 3 then 28 else 20 end"),
    ("size", "40 + cast(floor(value) as int)"),
    ("sport", "case when event_id % 10 in (0, 3) then null else 1024 + event_id % 1000 end"),
    ("dport", "case when event_id % 10 in (0, 3) then null else case " + K_EXPR + " % 10 "
              "when 0 then 80 when 1 then 443 when 2 then 53 when 3 then 22 when 4 then 23 "
              "when 5 then 25 when 6 then 67 when 7 then 6667 when 8 then 8080 else 9999 end end"),
    ("flags", "case when event_id % 10 <= 3 then 0 else case event_type when 'signup' then 2 "
              "when 'click' then 16 when 'purchase' then 17 when 'error' then 4 else 24 end end"),
    ("k", K_EXPR),
    ("user_id", "user_id"),
]

VERDICT_IN = [
    ("event_id", "event_id"),
    ("ts", "ts"),
    ("src_ip", "src_ip"),
    ("dst_ip", "dst_ip"),
    ("label", "case when k % 5 = 0 then 'BENIGN' else 'DDOS-SYN_FLOOD' end"),
    ("confidence", "cast(least(1.0, size / 100.0) as double)"),
    ("n_packets", "k"),
]

# Sources of users with user_id % 13 = 0 form the test safe list.
SAFE_LIST = [("ip", IP_OF_USER)]
SAFE_LIST_WHERE = "user_id % 13 = 0"


def _preds_cols(model: str, cut: int) -> list[tuple[str, str]]:
    return [
        ("event_id", "event_id"),
        ("file_id", "event_id % 10"),
        ("model", f"'{model}'"),
        ("y", "event_type"),
        ("yhat", f"case when {K_EXPR} < {cut} then event_type else case {K_EXPR} % 5 "
                 "when 0 then 'click' when 1 then 'view' when 2 then 'purchase' "
                 "when 3 then 'error' else 'refund' end end"),
    ]


PRED_MODELS = [("m1", 70), ("m2", 60), ("m3", 85)]

COMMAND_LOG = [
    ("event_id", "event_id"),
    ("ts", "ts"),
    ("ip", IP_OF_USER),
    ("op", "case event_type when 'purchase' then 'block' when 'error' then 'unblock' "
           "when 'signup' then 'add' when 'view' then 'remove' else 'none' end"),
    ("whitelisted", "user_id % 13 = 0"),
    ("attack_type", "event_type"),
]

ARP = [
    ("seen_order", "c_custkey"),
    ("ip", "concat('192.168.', cast(c_nationkey % 4 as string), '.', cast(c_custkey % 254 + 1 as string))"),
    ("mac", "concat(case c_custkey % 4 when 0 then 'B8:27:EB' when 1 then '24-0a-c4' "
            "when 2 then '00:17:88' else 'AA:BB:CC' end, ':00:', "
            "cast(cast(10 + floor((c_custkey % 700) / 90) as int) as string), ':', "
            "cast(10 + (c_custkey % 700) % 90 as string))"),
    ("subnet", "concat('192.168.', cast(c_nationkey % 4 as string), '.0/24')"),
]


@dataclass(frozen=True)
class Projection:
    name: str
    source: str            # a base table or another projection
    columns: list
    where: str | None = None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        src = PROJECTIONS[self.source].spark(spark, sf_dir) if self.source in PROJECTIONS \
            else table(spark, sf_dir, self.source)
        if self.where:
            src = src.where(self.where)
        return src.selectExpr(*[f"{e} AS {q_spark(n)}" for n, e in self.columns])

    def apply(self, src: DataFrame) -> DataFrame:
        """The projection over a given source frame (e.g. a stream of the base table)."""
        if self.where:
            src = src.where(self.where)
        return src.selectExpr(*[f"{e} AS {q_spark(n)}" for n, e in self.columns])

    def sql(self) -> str:
        src = f"({PROJECTIONS[self.source].sql()})" if self.source in PROJECTIONS else self.source
        where = f" WHERE {self.where}" if self.where else ""
        cols = ", ".join(f"{e} AS {q_sql(n)}" for n, e in self.columns)
        return f"SELECT {cols} FROM {src} AS src{where}"


PROJECTIONS: dict[str, Projection] = {}


def _register(p: Projection) -> Projection:
    PROJECTIONS[p.name] = p
    return p


_register(Projection("flows", "lineitem", FLOWS))
_register(Projection("flows_dirty", "lineitem", FLOWS_DIRTY))
_register(Projection("flows_ev", "events", FLOWS_EV))
_register(Projection("packets", "events", PACKETS))
_register(Projection("verdict_in", "packets", VERDICT_IN))
_register(Projection("safe_list", "events", SAFE_LIST, SAFE_LIST_WHERE))
_register(Projection("command_log", "events", COMMAND_LOG))
_register(Projection("arp", "customer", ARP))
for _m, _c in PRED_MODELS:
    _register(Projection(f"preds_{_m}", "events", _preds_cols(_m, _c)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection by name; ``preds`` is the union of the per-model blocks."""
    if name == "preds":
        out = None
        for m, _ in PRED_MODELS:
            df = PROJECTIONS[f"preds_{m}"].spark(spark, sf_dir)
            out = df if out is None else out.unionByName(df)
        return out
    if name == "safe_list":
        return PROJECTIONS[name].spark(spark, sf_dir).distinct()
    return PROJECTIONS[name].spark(spark, sf_dir)


def sql(name: str) -> str:
    if name == "preds":
        return " UNION ALL ".join(PROJECTIONS[f"preds_{m}"].sql() for m, _ in PRED_MODELS)
    if name == "safe_list":
        return f"SELECT DISTINCT * FROM ({PROJECTIONS[name].sql()}) AS s"
    return PROJECTIONS[name].sql()


def with_ctes(body: str, *names: str) -> str:
    """Prefix an oracle statement with CTEs for the projections it uses."""
    ctes = ",\n".join(f"{n} AS ({sql(n)})" for n in names)
    return f"WITH {ctes}\n{body}"
