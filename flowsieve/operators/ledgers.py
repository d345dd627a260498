"""Ledgers replayed from command logs: firewall blocks, safe list, device inventory."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import MAC_VENDORS, UNKNOWN_VENDOR
from . import scan

ORDER = ["ts", "event_id"]


def ipv4_valid(ip: Column) -> Column:
    """Four dot-separated parts, each an integer 0-255."""
    parts = F.split(ip, "[.]", -1)
    in_range = F.forall(parts, lambda p: F.coalesce(p.try_cast("int").between(0, 255), F.lit(False)))
    return F.coalesce((F.size(parts) == 4) & in_range, F.lit(False))


def block_ledger(commands: DataFrame, ip: str = "ip", op: str = "op",
                 whitelisted: str | None = "whitelisted") -> DataFrame:
    """Success of every block/unblock command (adds ``refused`` and ``success``).

    A block fails when the address is whitelisted (``refused``: no state
    change) or already blocked; an unblock fails when the address is not
    blocked.  After any command that is not refused the state equals its op, so
    success depends only on the previous non-refused command of the address
    (``scan.previous_value``).
    """
    cmds = commands.where(F.col(op).isin("block", "unblock"))
    refused = F.col(op) == "block"
    if whitelisted:
        refused = refused & F.coalesce(F.col(whitelisted), F.lit(False))
    else:
        refused = F.lit(False)
    cmds = cmds.withColumn("refused", refused)
    effective = cmds.where(~F.col("refused"))
    prev = scan.previous_value(effective, [ip], ORDER, op, "__prev")
    judged = prev.withColumn(
        "success", F.when(F.col(op) == "block", F.coalesce(F.col("__prev") != "block", F.lit(True)))
        .otherwise(F.coalesce(F.col("__prev") == "block", F.lit(False)))).drop("__prev")
    rejected = cmds.where(F.col("refused")).withColumn("success", F.lit(False))
    return judged.unionByName(rejected)


def blocked_list(judged: DataFrame, ip: str = "ip", op: str = "op", attack_type: str = "attack_type") -> DataFrame:
    """Final block list: addresses whose last non-refused command is a block, with the
    time and type of the block that opened the current run (its last accepted block)."""
    order = F.struct(*[F.col(c) for c in ORDER])
    opened = F.when((F.col(op) == "block") & F.col("success"),
                    F.struct(*[F.col(c) for c in ORDER], F.col(attack_type).alias("attack_type")))
    agg = judged.where(~F.col("refused")).groupBy(ip).agg(
        F.max_by(F.col(op), order).alias("__last_op"), F.max(opened).alias("__open"))
    return agg.where(F.col("__last_op") == "block").select(
        ip, F.col("__open.ts").alias("blocked_at"), F.col("__open.attack_type").alias("attack_type"))


def safe_list_apply(commands: DataFrame, defaults: list[str], ip: str = "ip", op: str = "op") -> DataFrame:
    """Final safe list from an add/remove log plus default addresses.

    An add needs a valid IPv4 address (invalid adds are rejected); a remove
    always applies.  The last applied op per address wins (``max_by``, a
    partial aggregation); defaults count as adds before every logged op.
    """
    applied = commands.where(((F.col(op) == "add") & ipv4_valid(F.col(ip))) | (F.col(op) == "remove"))
    logged = applied.select(ip, op, F.struct(F.lit(1).alias("__logged"), *[F.col(c) for c in ORDER]).alias("__o"))
    spark = commands.sparkSession
    base = spark.createDataFrame([(d,) for d in defaults], f"{ip} string") if defaults else None
    if base is not None:
        base = base.select(ip, F.lit("add").alias(op),
                           F.struct(F.lit(0).alias("__logged"),
                                    *[F.lit(None).cast(commands.schema[c].dataType).alias(c) for c in ORDER])
                           .alias("__o"))
        logged = logged.unionByName(base)
    last = logged.groupBy(ip).agg(F.max_by(F.col(op), F.col("__o")).alias("__last"))
    return last.where(F.col("__last") == "add").select(ip)


def vendor_map() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(p), F.lit(v)) for p, v in MAC_VENDORS))


def normalize_mac(mac: Column) -> Column:
    return F.regexp_replace(F.upper(mac), "-", ":")


def oui_vendor(mac: Column) -> Column:
    """Vendor of the first three octets of a normalised MAC, else the unknown label."""
    prefix = F.substring(normalize_mac(mac), 1, 8)
    return F.coalesce(F.try_element_at(vendor_map(), prefix), F.lit(UNKNOWN_VENDOR))


def device_dedup(replies: DataFrame, mac: str = "mac", order: str = "seen_order") -> DataFrame:
    """First reply per normalised MAC (a per-MAC ``min`` of a struct: partial aggregation)."""
    norm = replies.withColumn("__mac", normalize_mac(F.col(mac)))
    others = [c for c in replies.columns if c not in (mac, order)]
    first = norm.groupBy("__mac").agg(F.min(F.struct(F.col(order), *[F.col(c) for c in others])).alias("__f"))
    return first.select(F.col("__mac").alias(mac), *[F.col(f"__f.{c}").alias(c) for c in [order, *others]])


def ip_octets(ip: Column) -> list[Column]:
    parts = F.split(ip, "[.]", -1)
    return [F.element_at(parts, i).try_cast("int") for i in range(1, 5)]


def sort_by_ip(devices: DataFrame, ip: str = "ip", tie: str = "seen_order") -> DataFrame:
    """Global rank by numeric octets (scan: no single-task window)."""
    octs = devices.select("*", *[o.alias(f"__o{i}") for i, o in enumerate(ip_octets(F.col(ip)))])
    ranked = scan.row_number(octs, [], [f"__o{i}" for i in range(4)] + [tie], "ip_rank")
    return ranked.drop(*[f"__o{i}" for i in range(4)])


def device_inventory(replies: DataFrame, subnet: str = "subnet") -> DataFrame:
    """Replies -> first per MAC -> vendor -> ordered by address, with devices per subnet."""
    devices = device_dedup(replies).withColumn("vendor", oui_vendor(F.col("mac")))
    per_subnet = devices.groupBy(subnet).agg(F.count(F.lit(1)).alias("subnet_devices"))
    return sort_by_ip(devices).join(per_subnet, subnet, "left")
