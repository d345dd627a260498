"""Exact dedup by distributed most-significant-digit radix partitioning.

Documents are split by successive bytes of their text.  The first digit is the
first ``WIDTH`` bytes; each later digit is ``GROWTH`` times as wide, so a text of
n bytes takes log(n) rounds.  A round groups the documents that still share a
group by (group, digit).  A group of one is settled: its text is unique.  A
digit shorter than its width means that the texts have ended, so the members
are equal byte for byte; no digest decides anything.  Only documents that share
their first digit with another one are read again, and of them only the digits
of rounds they reach are compared.

A group may hold a third of all rows, so a round first aggregates per (group,
digit, salt), combines the few salted rows, and joins back on the salted key: no
task sees more of a group than its salt's share.

Edge cases: null text equals empty text; equal texts with the same doc_id (or
null ones) are rows of their own, and of these the one read last stays; null
doc_ids come before all others, so a null row stays only if all are null; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.session import scratch_path

from .common import grouped, join_checked, keyed, numbered, store, without

WIDTH = 64
GROWTH = 8


def digit_borders(width: int, growth: int, most: int = 1 << 31) -> list[int]:
    """First byte of every digit."""
    borders, step = [0], width
    while borders[-1] + step < most:
        borders.append(borders[-1] + step)
        step *= growth
    return borders


def split(rows: DataFrame) -> DataFrame:
    """Groups of equal (group, digit) with at least two rows.

    ``rows``: row_id, doc_id, grp, digit, ended.  Returns row_id, doc_id, grp
    (the row_id of the member that would stay), keep_id, n, ended.
    """
    met = grouped(rows, ["grp", "digit"], ["row_id"],
                  {"best": (F.max(F.struct("doc_id", "row_id")), F.max), "n": (F.count(F.lit(1)), F.sum)}, "n > 1")
    return met.select("row_id", "doc_id", F.col("best.row_id").alias("grp"), F.col("best.doc_id").alias("keep_id"),
                      "n", "ended")


def equal_groups(rows: DataFrame, width: int = WIDTH, growth: int = GROWTH) -> DataFrame:
    """``row_id, grp, keep_id, n`` of every row whose text another row has too; ``rows`` from ``common.keyed``."""
    spark = rows.sparkSession
    borders = digit_borders(width, growth)
    data = F.col("text").cast("binary")
    first = rows.select("row_id", "doc_id", F.lit(0).cast("long").alias("grp"),
                        F.substring(data, 1, width).alias("digit"), (F.octet_length("text") < width).alias("ended"))
    found = store(split(first), "radix-0")
    settled = found.filter("ended")
    alive = found.filter("not ended")
    n_alive = alive.count()
    if not n_alive:
        return settled.select("row_id", "grp", "keep_id", "n")

    # later digits of the documents that are left, one folder per round
    digits = scratch_path(spark, "llm-digits")
    starts = F.filter(F.array(*[F.lit(b) for b in borders[1:]]), lambda b: b <= F.octet_length("text"))
    (join_checked(rows.select("row_id", "text"), alive.select("row_id"), "row_id", "inner", 16, n_alive)
     .select("row_id", data.alias("data"), F.posexplode(starts).alias("round", "start"))
     .select("row_id", "round", F.substring("data", F.col("start") + 1,
                                            (F.lit(width) * F.pow(F.lit(growth), F.col("round") + 1)).cast("int"))
             .alias("digit"))
     .write.partitionBy("round").option("compression", "zstd").parquet(digits))
    pieces = spark.read.schema("row_id long, digit binary, round int").parquet(digits)
    for k in range(len(borders) - 1):
        digit = pieces.filter(F.col("round") == k).select("row_id", "digit")
        now = alive.select("row_id", "doc_id", "grp").join(digit, "row_id").withColumn(
            "ended", F.length("digit") < width * growth ** (k + 1))
        found = store(split(now), f"radix-{k + 1}")
        settled = settled.unionByName(found.filter("ended"))
        alive = found.filter("not ended")
        if not alive.limit(1).count():
            break
    return settled.select("row_id", "grp", "keep_id", "n")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                growth: int = GROWTH) -> DataFrame:
    """``doc_id, text, keep_id, group_size, kept`` of every row; of equal texts the largest ``key`` stays."""
    rows = keyed(docs, key, text)
    groups = store(equal_groups(rows, width, growth), "equal-groups")
    joined = join_checked(rows, groups, "row_id", "left", 64)
    return joined.select(
        "doc_id", "text", F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("grp", "row_id") == F.col("row_id")).alias("kept"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each text, columns as they were; rows are judged one by one, also those that share a key or have none."""
    rows, row = numbered(docs, key, text, nulls_first=True)
    return without(rows, row, exact_dedup(rows, row, text).filter("not kept").select("doc_id")).drop(row)
