"""The skew-safe scan: balance of its tasks, its exchanges, its cost to build, nulls."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsieve.operators import scan


@pytest.fixture
def plain(spark):
    """Partitions as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def hot(spark, n=40_000):
    """Two thirds of the rows under one key, the order unlike the input's."""
    return spark.range(n).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 500).alias("k"),
                                 (F.col("id") * 7919 % n).alias("t"))


def test_no_task_above_twice_the_mean(plain):
    rows = hot(plain)
    safe = plain.createDataFrame([(-1,)], "k long").hint("merge")
    left = rows.join(safe, "k", "left_anti")  # lies by key: the scan must deal anew
    dealt = scan.dealt(scan.with_slice(left, [F.col("k"), F.col("t")], scan._slices(left)).withColumn("__gk", F.struct("k")))
    tasks = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(tasks) == 8 and max(tasks) <= 2 * sum(tasks) / len(tasks), tasks


def test_running_after_a_join_on_its_key(plain):
    rows = hot(plain)
    safe = plain.createDataFrame([(-1,)], "k long").hint("merge")
    got = scan.row_number(rows.join(safe, "k", "left_anti"), ["k"], ["t"])
    want = rows.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("t")))
    assert got.join(want, ["k", "t"]).where("rn <> w").count() == 0 and got.count() == rows.count()


def test_nulls_in_key_and_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"]), None if i == 5 else i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(3)
    got = {(r.k, r.t): (r.s, r.m, r.s_total) for r in scan.running(df, ["k"], ["t"], {"s": ("sum", "v"), "m": ("max", "v")}, totals=True).collect()}
    for key in (None, "a", "b"):
        total = top = 0
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0))
        for k, t, v in own:
            total, top = total + v, max(top, v)
            assert got[k, t] == (total, top, sum(r[2] for r in own))


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t long")
    assert scan.row_number(df, ["k"], ["t"]).count() == 0 and scan.row_number(df, [], ["t"]).count() == 0


def test_building_runs_nothing_and_is_quick(spark):
    df = hot(spark)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    t = time.time()
    out = scan.running(df, ["k"], ["t"], {"n": ("count", None)}, num_partitions=2000)
    assert time.time() - t < 2
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert out.where("n < 1").count() == 0


def test_rows_are_dealt_once(spark):
    """Rows of a table are exchanged by the scan once; the join with the offsets adds none on their side."""
    rows = hot(spark).withColumn("payload", F.concat(F.lit("x"), "t"))
    out = scan.row_number(rows, ["k"], ["t"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.splitlines() if "Exchange" in x and "__pid" in x and "REPARTITION" in x]
    assert len(wide) == 1
    side = [x for x in plan.splitlines() if "Exchange" in x and "ENSURE_REQUIREMENTS" in x and "payload" in x]
    assert not side
