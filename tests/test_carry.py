"""The carry scan against a sequential loop: several levels, a hot key, null keys, numbers below zero."""

import random
import statistics
from datetime import datetime, timedelta

import pytest

from flowsieve.operators import carry

PACKET = ("event_id long, ts timestamp_ntz, src_ip string, dst_ip string, proto int, header_len int, size int, "
          "sport int, dport int, flags int")


@pytest.mark.parametrize("block,levels,m", [(4, 6, 3), (7, 4, 5), (512, 2, 1), (3, 8, 2)])
def test_closed_before_is_the_sequential_walk(spark, block, levels, m):
    rng = random.Random(block)
    keys = ["hot"] * 6 + ["a", None, "b"]
    rows = {}
    for _ in range(1500):
        rows[rng.choice(keys), rng.randint(-900, 2500)] = rng.choice((1, 1, 1, 2, 3, 9))
    df = spark.createDataFrame([(k, i, n, {"x": i}) for (k, i), n in rows.items()], "k string, i long, n long, more map<string,long>")
    got = {(r.k, r.i): r.closed for r in carry.closed_before(df.repartition(5), ["k"], "i", "n", m, levels, block).collect()}
    want = {}
    for key in set(k for k, _ in rows):
        held = closed = 0
        for i in sorted(i for k, i in rows if k == key):
            want[key, i] = closed
            held += rows[key, i]
            if held >= m:
                held, closed = 0, closed + 1
    assert got == want


def test_features_of_merged_windows(spark):
    """Spread of sizes far from zero, last values and flags, by hand; packets without a time and a key without enough packets."""
    rng = random.Random(9)
    t0 = datetime(1969, 12, 31, 23, 0)
    rows = []
    for e in range(400):
        src = rng.choice(["10.0.0.1"] * 5 + ["10.0.0.2", None])
        rows.append((e, t0 + timedelta(seconds=rng.randint(0, 7000)), src, f"d{e % 7}", rng.choice((6, 17, None)), 20,
                     10_000_000 + rng.randint(0, 3), 1024, rng.choice((80, 53, 9)), rng.choice((2, 16, 24))))
    rows += [(1000, None, "10.0.0.1", "d", 6, 20, 1, 1, 1, 1), (1001, t0, "lone", "d", 6, 20, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, PACKET).repartition(4)
    got = {(r.key_src_ip, r.window_first_start): r for r in carry.carry_over_windows(df, "10 seconds", ["src_ip"], block=8).collect()}
    seen = 0
    for src in ("10.0.0.1", "10.0.0.2", None):
        wins, held = {}, []
        for r in rows:
            if r[2] == src and r[1] is not None:
                wins.setdefault((r[1] - t0) // timedelta(seconds=10), []).append(r)
        first = None
        for w in sorted(wins):
            first = w if first is None else first
            held += wins[w]
            if len(held) < 3:
                continue
            r = got[src, t0 + timedelta(seconds=10 * first)]
            sizes, last = [x[6] for x in held], max(held, key=lambda x: (x[1], x[0]))
            assert r.Number == len(held) and r.window_end == t0 + timedelta(seconds=10 * w + 10)
            assert abs(r.Variance - statistics.pvariance(sizes)) < 1e-9 and r["Tot sum"] == sum(sizes)
            assert r.dst_ip == last[3] and r.HTTP == float(any(x[8] == 80 and x[4] for x in held))
            assert r.syn_count == sum(x[4] == 6 and x[9] & 2 > 0 for x in held)
            protos = [x for x in held if x[4] is not None]
            assert r["Protocol Type"] == (max(protos, key=lambda x: (x[1], x[0]))[4] if protos else None)
            held, first, seen = [], None, seen + 1
    assert seen == len(got)


def test_empty(spark):
    assert carry.carry_over_windows(spark.createDataFrame([], PACKET), "1 second").count() == 0
