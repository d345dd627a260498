"""Column expressions over decoded packet records.

Packet record: ``ts, src_ip, dst_ip, proto, sport, dport, size, header_len,
flags`` (+ a unique ``event_id`` used to break time ties).  Everything here is a
built-in expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import (ARP_HEADER_LEN, IP_PROTOCOL_NUMBERS, OTHER_HEADER_LEN,
                        PORT_PROTOCOLS, TCP_FLAG_BITS)


def is_tcp(proto: str = "proto") -> Column:
    return F.col(proto) == 6


def carries_ports(proto: str = "proto") -> Column:
    """Only TCP and UDP packets contribute ports to a flow's port set."""
    return F.col(proto).isin(6, 17)


def flag_bit(name: str, flags: str = "flags") -> Column:
    """1 when the TCP flag ``name`` is set on a TCP packet, else 0."""
    bit = TCP_FLAG_BITS[name]
    return F.when(is_tcp() & (F.col(flags).bitwiseAND(bit) > 0), 1).otherwise(0)


def tcp_flag_columns() -> list[Column]:
    return [flag_bit(n).alias(n) for n in TCP_FLAG_BITS]


def layer(proto: str = "proto") -> Column:
    """ARP when protocol 0, IP when a protocol number is present, else OTHER."""
    return (F.when(F.col(proto) == 0, F.lit("ARP"))
            .when(F.col(proto).isNotNull(), F.lit("IP"))
            .otherwise(F.lit("OTHER")))


def layer_header_len(header_len: str = "header_len", proto: str = "proto") -> Column:
    """IP: the header length field (4 * IHL); ARP: 28; other frames: 14."""
    return (F.when(F.col(proto) == 0, F.lit(ARP_HEADER_LEN))
            .when(F.col(proto).isNotNull(), F.col(header_len))
            .otherwise(F.lit(OTHER_HEADER_LEN)))


def port_in(name: str) -> Column:
    ports = PORT_PROTOCOLS[name]
    return carries_ports() & (F.col("sport").isin(*ports) | F.col("dport").isin(*ports))


def port_indicator_aggs() -> list[Column]:
    """Per group: 1 when any TCP/UDP packet used one of the protocol's ports."""
    return [F.max(F.when(port_in(n), 1).otherwise(0)).alias(f"__port_{n}") for n in PORT_PROTOCOLS]


def last_by_time(value: str, ts: str = "ts", tie: str = "event_id") -> Column:
    """Value of the latest packet (by ts, then tie key) among rows where it is not null."""
    order = F.when(F.col(value).isNotNull(), F.struct(F.col(ts), F.col(tie)))
    return F.max_by(F.col(value), order)


def protocol_indicator_map(proto: Column, src: Column) -> dict[str, Column]:
    """The protocol-number indicators (ARP, ICMP, TCP, UDP, IPv, LLC) as doubles."""
    one = F.lit(1.0)
    zero = F.lit(0.0)
    return {
        "ARP": F.when((proto == 0) & src.isNotNull(), one).otherwise(zero),
        "ICMP": F.when(proto == 1, one).otherwise(zero),
        "TCP": F.when(proto == 6, one).otherwise(zero),
        "UDP": F.when(proto == 17, one).otherwise(zero),
        "IPv": F.when(proto.isin(*IP_PROTOCOL_NUMBERS), one).otherwise(zero),
        "LLC": zero,
    }


def protocol_indicators(proto: Column, src: Column) -> list[Column]:
    return [c.alias(n) for n, c in protocol_indicator_map(proto, src).items()]
