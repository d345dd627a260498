"""First and last rows per key without a sort of all rows, against plain ranks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsieve.operators import selection


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(3000):
        key = rng.choice(["hot"] * 6 + ["b", None, "c"])
        x = rng.choice([None, float("nan"), float(rng.randint(0, 50)), rng.gauss(1e6, 3.0), -1e9, 5.0, 5.0])
        out.append((key, x, i, f"s{i}"))
    out += [("few", 1.0, 9001, "s"), ("few", None, 9002, "s"), ("same", 7.0, 9100, "s")] + [("same", 7.0, 9200 + i, "s") for i in range(30)]
    return spark.createDataFrame(out, "key string, x double, id long, text string").repartition(5)


@pytest.mark.parametrize("k", [1, 25, 5000])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("bins", [7, 1024])
def test_first_k_is_the_plain_rank(rows, k, descending, bins):
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("x", "id")]
    want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rn") <= k)
    got = selection.first_k(rows, ["key"], ["x", "id"], k, "rn", descending, bins)
    assert got.columns == [*rows.columns, "rn"]
    assert sorted((r.id, r.rn) for r in got.collect()) == sorted((r.id, r.rn) for r in want.collect())


def test_kth(rows):
    got = {r.key: tuple(r.t)[1] for r in selection.kth(rows, ["key"], ["x", "id"], 20, "t").collect()}
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("x", "id")))
    sizes = {r.key: r["count"] for r in rows.groupBy("key").count().collect()}
    want = {r.key: r.id for r in ranked.where("rn = 20").collect() if sizes[r.key] > 20}
    assert got == want and "few" not in got


def test_text_order_and_empty(rows, spark):
    got = selection.first_k(rows, ["key"], ["text", "id"], 3, "rn")
    assert got.groupBy("key").count().where("count > 3").count() == 0 and got.count() == 3 * 5 + 2
    assert selection.first_k(rows.limit(0), ["key"], ["x"], 3).count() == 0
    assert selection.first_k(rows, [], ["id"], 4).count() == 4


def test_rows_are_cut_before_they_are_sorted(spark):
    df = spark.range(100_000).select((F.col("id") % 2).alias("k"), "id")
    cut = selection.up_to_bin(df, ["k"], ["id"], 100)
    assert cut.count() <= 2 * (100 + 50_000 / selection.BINS + 1)
