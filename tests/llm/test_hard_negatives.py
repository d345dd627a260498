"""Hard-negative mining against brute force in Python integers."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowsieve.llm import hard_negatives as hn
from flowsieve.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, key long, score double"


def by_hand(rows, depth=5, percent=80):
    """rows: (vec_id, vector, label); anchors have a vec_id divisible by 100."""
    good = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        good.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for i, v, label in good:
        if i % 100:
            continue
        scored = [(max(-hn.LIMIT, min(hn.LIMIT, sum(a * b for a, b in zip(v, w)))), j, m)
                  for j, w, m in good if j != i and len(w) == len(v)]
        order = sorted(scored, key=lambda x: (-x[0], x[1]))
        for s, j, _ in [x for x in order if x[2] == label][:depth]:
            fits = [x for x in order if x[2] != label and percent * s <= 100 * x[0] <= 100 * s][:depth]
            out += [(i, j, r + 1, x[1], s, x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % 100 == 0, **more).collect())


def test_packed_products_are_exact():
    rng = np.random.default_rng(3)
    for high, d in ((1, 1), (2, 300), (256, 64), (5000, 7), (1 << 23, 4), (1 << 29, 33), (1 << 31, 5)):
        for low in (-high, 0, high // 2):
            a = rng.integers(low, high + 1, (6, d)).astype(float)
            c = rng.integers(low, high + 1, (45, d)).astype(float)
            exact = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in c] for p in a]
            exact = [[max(-hn.LIMIT, min(hn.LIMIT, x)) for x in row] for row in exact]
            assert hn.packed_scores(a, c).tolist() == exact, (high, low, d)
    assert hn.packed_scores(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2


def test_ties_nulls_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.0, -0.25, 0.0, 0.5, 1.0)) for _ in range(3)], rng.choice((1, 1, 1, 2, 3))) for i in range(260)]
    rows += [(i, list(rows[7][1]), 1) for i in range(300, 340)]  # equal vectors: ties by key
    rows += [(100, [1.0, 1.0, 0.5], 2), (100, [1.0, 1.0, 0.5], 2), (17, [1.0, 0.5, 1.0], 1)]  # repeated keys
    rows += [(None, [1.0, 1.0, 1.0], 1), (400, None, 1), (500, [1.0, 1.0, 1.0], None), (600, [1.0, None, 1.0], 2),
             (700, [float("nan"), 1.0, 1.0], 1), (701, [float("inf"), 1.0, 1.0], 1), (800, [1e308, 1.0, 1.0], 1),
             (900, [], 1), (901, [], 1), (902, [], 2), (1000, [1.0, 1.0], 1), (-100, [0.5, 1.0, -1.0], 3)]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, rows, chunk_bytes=200) == by_hand(rows)  # many chunks of anchors


def test_large_components(spark):
    rng = random.Random(6)
    rows = [(i * 50, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 17) for _ in range(4)], i % 3) for i in range(40)]
    assert run(spark, rows) == by_hand(rows)


def test_nothing_to_mine(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert run(spark, [(100, [1.0], 1), (2, [1.0], 2)]) == []  # no positive
    assert run(spark, [(100, [1.0], 1), (2, [1.0], 1)]) == []  # no negative


def test_query_on_whole_table(spark):
    got = sorted(tuple(r) for r in queries.QUERIES["op11_hard_negatives"](spark, SF_SMALL).collect())
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert got == by_hand(rows) and got
