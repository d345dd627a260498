"""The keyed permutation: a bijection for every size, unlike the identity, different for every key."""

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import permute


def places(spark, n, key):
    df = spark.range(n).select("id", permute.place(F.col("id"), F.lit(n).cast("long"), F.lit(key).cast("long")).alias("p"))
    return [r.p for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 97, 1000])
def test_bijection(spark, n):
    for key in (0, 42, -7, 2**40):
        assert sorted(places(spark, n, key)) == list(range(n))


def test_order_is_lost(spark):
    a, b = places(spark, 1000, 1), places(spark, 1000, 2)
    assert sum(x == y for x, y in zip(a, b)) < 20 and sum(x == i for i, x in enumerate(a)) < 20
    near = sum(abs(a[i] - a[i + 1]) <= 10 for i in range(999))
    assert near < 60 and abs(sum(a[:500]) / 500 - 499.5) < 60
