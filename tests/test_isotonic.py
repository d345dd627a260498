"""Isotonic calibration against a sequential pool-adjacent-violators loop."""

import random

import numpy as np

from flowsieve.operators import isotonic


def by_hand(points):
    """Value of each distinct p from (p, target) rows."""
    ps = sorted({p for p, _ in points})
    blocks = []
    for p in ps:
        own = [t for q, t in points if q == p]
        blocks.append([[p], sum(own), len(own)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    return {p: t / n for own, t, n in blocks for p in own}


def test_blocks_of_partitions_merge_to_the_whole(spark):
    rng = random.Random(3)
    rows = []
    for i in range(2500):
        p = [rng.choice([round(rng.random(), 3), 0.25]) for _ in range(3)]
        y = max(range(3), key=lambda k: p[k] + rng.gauss(0, 0.4))
        rows.append((i, p, y))
    rows += [(9000, None, 1), (9001, [0.5, None, float("nan")], 0), (9002, [0.1, 0.2, 0.3], None)]
    df = spark.createDataFrame(rows, "id long, p array<double>, y int").repartition(7)
    blocks = isotonic.fit(df, "p", "y").collect()
    known = isotonic.functions(blocks)
    for k in range(3):
        want = by_hand([(p[k], float(y == k)) for _, p, y in rows
                        if p is not None and y is not None and p[k] is not None and p[k] == p[k]])
        at, value = known[k]
        assert np.allclose(np.interp(list(want), at, value), list(want.values()), atol=1e-12)
        assert (np.diff(value[::2]) > 0).all()
    out = {r.id: r.calibrated for r in isotonic.calibrate(df.where("id < 9001"), "p", blocks).collect()}
    assert out[9000] is None
    for i, p, _ in rows[:200]:
        q = [np.interp(p[k], *known[k]) for k in range(3)]
        s = sum(q)
        assert np.allclose(out[i], [x / s for x in q] if s else [1 / 3] * 3)


def test_empty_and_all_zero(spark):
    none = spark.createDataFrame([], "p array<double>, y int")
    assert isotonic.fit(none, "p", "y").collect() == []
    df = spark.createDataFrame([([0.4, 0.6], 5)], "p array<double>, y int")
    blocks = isotonic.fit(df, "p", "y").collect()
    assert isotonic.calibrate(df, "p", blocks).first().calibrated == [0.5, 0.5]
    assert isotonic.calibrate(df, "p", []).first().calibrated == [0.4, 0.6]
