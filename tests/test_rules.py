"""Sequential rules of the tool, written as plain loops, against the Spark operators on
random inputs with one hot key (a third or more of all rows)."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsieve.contract import FIREWALL_WHITELIST
from flowsieve.operators import ledgers, sampling, scan, verdicts

T0 = datetime(2024, 1, 1)


def _ladder(label, conf, n):
    conf = 0.5 if conf is None else conf
    if label == "BENIGN":
        return "BENIGN"
    if conf < 0.70 or n < 5:
        return "FP_PREVENT"
    if conf < 0.95 or n < 10:
        return "ALERT_ONLY"
    return "BLOCK"


def _reference_decisions(rows):
    counter, blocked, out = {}, set(), {}
    for eid, ts, src, label, conf, n in sorted(rows, key=lambda r: (r[1], r[0])):
        d = _ladder(label, conf, n)
        esc, acts = False, 0
        if d == "BENIGN":
            counter.pop(src, None)
        elif d == "ALERT_ONLY":
            counter[src] = counter.get(src, 0) + 1
            if counter[src] >= 3:
                esc, acts = True, 1
                counter.pop(src, None)
        elif d == "BLOCK":
            acts = 1
            counter.pop(src, None)
        accepted = False
        if acts and src not in FIREWALL_WHITELIST and src not in blocked:
            accepted = True
            blocked.add(src)
        out[eid] = (d, esc, accepted)
    return out


def _random_verdicts(seed, n=600):
    rnd = random.Random(seed)
    srcs = ["10.0.0.1"] * 6 + ["10.0.0.2", "10.0.0.3", "127.0.0.1", "10.0.0.4"]
    rows = []
    for i in range(n):
        rows.append((i, T0 + timedelta(seconds=rnd.randint(0, 5000)), rnd.choice(srcs),
                     rnd.choice(["BENIGN", "DDOS", "DDOS", "DDOS"]),
                     rnd.choice([None, 0.5, 0.75, 0.8, 0.96, 0.99, 0.99]), rnd.choice([3, 7, 12, 20])))
    return rows


def test_repeat_offender_and_block_acceptance_match_loop(spark):
    for seed in range(3):
        rows = _random_verdicts(seed)
        df = spark.createDataFrame(rows, "event_id long, ts timestamp, src_ip string, label string, "
                                         "confidence double, n_packets int").withColumn("dst_ip", F.lit("x"))
        got = {r["event_id"]: (r["decision"], r["escalated"], r["block_accepted"])
               for r in verdicts.decide(df, None).collect()}
        assert got == _reference_decisions(rows)


def test_block_ledger_matches_loop(spark):
    rnd = random.Random(7)
    ips = ["1.1.1.1"] * 5 + ["2.2.2.2", "3.3.3.3"]
    rows = [(i, T0 + timedelta(seconds=rnd.randint(0, 900)), rnd.choice(ips), rnd.choice(["block", "unblock"]),
             rnd.random() < 0.15, "t") for i in range(500)]
    blocked, want = set(), {}
    for eid, ts, ip, op, white, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if op == "block":
            ok = not white and ip not in blocked
            if ok:
                blocked.add(ip)
        else:
            ok = ip in blocked
            blocked.discard(ip)
        want[eid] = ok
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, ip string, op string, whitelisted boolean, "
                                     "attack_type string")
    judged = ledgers.block_ledger(df)
    assert {r["event_id"]: r["success"] for r in judged.collect()} == want
    final = {r["ip"] for r in ledgers.blocked_list(judged).collect()}
    assert final == blocked


def test_stratified_cap_sample_matches_loop(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 5), rnd.choice(["A", "A", "A", "B", "C"])) for i in range(3000)]
    rows_per_file, cap = 200, 150
    per_class, want = {}, set()
    for f in sorted({r[1] for r in rows}):
        head = sorted([r for r in rows if r[1] == f])[:rows_per_file]
        for cls in ["A", "B", "C"]:
            take = [r for r in head if r[2] == cls][: max(0, cap - per_class.get(cls, 0))]
            per_class[cls] = per_class.get(cls, 0) + len(take)
            want |= {r[0] for r in take}
    df = spark.createDataFrame(rows, "row_key long, file_id int, label string")
    got = {r["row_key"] for r in sampling.stratified_cap_sample(df, "file_id", "row_key", "label",
                                                                rows_per_file, cap).collect()}
    assert got == want


def test_running_number_matches_window_on_hot_key(spark):
    rnd = random.Random(11)
    rows = [(i, "hot" if rnd.random() < 0.6 else rnd.choice("abcdef"), rnd.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    ours = scan.running(df, ["k"], ["v", "id"], {"rn": ("count", None), "s": ("sum", F.col("v")),
                                                  "m": ("max", F.col("id"))}, totals=True)
    w = Window.partitionBy("k").orderBy("v", "id")
    ref = df.select("id", F.row_number().over(w).alias("rn2"), F.sum("v").over(w).alias("s2"),
                    F.max("id").over(w).alias("m2"), F.count(F.lit(1)).over(Window.partitionBy("k")).alias("t2"))
    j = ours.join(ref, "id")
    bad = j.where((F.col("rn") != F.col("rn2")) | (F.abs(F.col("s") - F.col("s2")) > 1e-9)
                  | (F.col("m") != F.col("m2")) | (F.col("rn_total") != F.col("t2")))
    assert j.count() == 4000 and bad.count() == 0


def test_previous_value_is_lag(spark):
    rows = [(i, i % 3, f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k long, v string")
    out = {r["id"]: r["prev"] for r in scan.previous_value(df, ["k"], ["id"], "v", "prev").collect()}
    assert out == {i: (f"v{i - 3}" if i >= 3 else None) for i in range(300)}


def test_carry_over_windows_match_loop(spark):
    from flowsieve import fixtures as fx
    from flowsieve.operators import carry
    from conftest import SF_SMALL
    packets = fx.load(spark, SF_SMALL, "packets")
    got = sorted((r["key_src_ip"], r["window_end"], int(r["Number"]))
                 for r in carry.carry_over_windows(packets, "1 hour", ["src_ip"]).collect())
    per = {}
    for r in packets.select("src_ip", F.window("ts", "1 hour").alias("w")).collect():
        per.setdefault(r["src_ip"], {}).setdefault(r["w"].end, 0)
        per[r["src_ip"]][r["w"].end] += 1
    want = []
    for src, wins in per.items():
        acc = 0
        for end in sorted(wins):
            acc += wins[end]
            if acc >= 3:
                want.append((src, end, acc))
                acc = 0
    assert got == sorted(want)


def test_chunk_shuffle_is_a_permutation(spark):
    from flowsieve.plans import catalog
    from conftest import SF_SMALL
    out = catalog.QUERIES["chunk_shuffle"](spark, SF_SMALL)
    agg = out.groupBy("file_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"),
                                                 F.max("pos").alias("hi"), F.countDistinct("pos").alias("d"))
    assert agg.where("lo != 1 OR hi != n OR d != n").count() == 0


def test_global_carry_over_windows_match_loop(spark):
    from flowsieve import fixtures as fx
    from flowsieve.operators import carry
    from conftest import SF_SMALL
    packets = fx.load(spark, SF_SMALL, "packets")
    got = sorted((r["window_end"], int(r["Number"])) for r in carry.carry_over_windows(packets, "1 hour").collect())
    wins = {}
    for r in packets.select(F.window("ts", "1 hour").alias("w")).collect():
        wins[r["w"].end] = wins.get(r["w"].end, 0) + 1
    want, acc = [], 0
    for end in sorted(wins):
        acc += wins[end]
        if acc >= 3:
            want.append((end, acc))
            acc = 0
    assert got == want
