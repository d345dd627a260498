"""Streams over several files out of order, stopped, restarted and replayed: equal to the batch or a sequential loop."""

import json
from collections import Counter
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowsieve.operators import sgd, verdicts
from flowsieve.plans import stream_queries as sq
from flowsieve.plans import train_queries
from flowsieve.sources import alert_sink
from flowsieve.streaming.store import BatchStore
from flowsieve.streaming.training import model_rows
from flowsieve.streaming.verdicts import TOTALS, VerdictStream
from test_rules import T0, _random_verdicts, _reference_decisions

ROW = "event_id long, ts timestamp, src_ip string, dst_ip string, label string, confidence double, n_packets int"


class Crash(Exception):
    pass


def crashing(cls, at):
    """A stream that fails once, after writing batch ``at`` and before it is valid."""
    left = [at]

    class Crashing(cls):
        def before_commit(self, number):
            super().before_commit(number)
            if left and left[0] == number:
                left.clear()
                raise Crash(str(number))
    return Crashing


def run_files(spark, tmp_path, files, make, rows=ROW):
    """Each file is one arrival; a run that fails is started again."""
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    restarts = 0
    for part in files:
        spark.createDataFrame(part, rows).repartition(2).write.mode("append").parquet(src)
        while True:
            run = make()
            try:
                (spark.readStream.schema(rows).parquet(src).writeStream.foreachBatch(run.apply)
                 .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
                break
            except Exception as e:
                assert "Crash" in str(e), e
                restarts += 1
    return run, restarts


def shuffled_files(seed, n=600, parts=4):
    """Random verdict rows (a hot source), each arriving up to 999 s after its time."""
    rows = [(e, ts, src, "d", label, conf, k) for e, ts, src, label, conf, k in _random_verdicts(seed, n)]
    order = sorted(rows, key=lambda r: r[1] + timedelta(seconds=(r[0] * 37) % 1000))
    size = -(-len(order) // parts)
    return rows, [order[i:i + size] for i in range(0, len(order), size)]


@pytest.mark.parametrize("crash_at", [None, 2])
def test_verdicts_out_of_order_with_crash_and_restart(spark, tmp_path, crash_at):
    rows, files = shuffled_files(3)
    safe = spark.createDataFrame([("10.0.0.3",)], "ip string")
    cls = VerdictStream if crash_at is None else crashing(VerdictStream, crash_at)
    run, restarts = run_files(spark, tmp_path, files, lambda: cls(spark, str(tmp_path / "t"), safe, "1000 seconds"))
    assert restarts == (crash_at is not None)
    schema = spark.createDataFrame([], ROW).schema
    out = run.decided(schema).collect()
    assert len(out) == len(rows) == len({r.event_id for r in out}) and run.late(schema).count() == 0
    want = _reference_decisions([(r[0], r[1], r[2], *r[4:]) for r in rows if r[2] != "10.0.0.3"])
    assert {r.event_id: (r.decision, r.escalated, r.block_accepted) for r in out if r.decision != "SAFE_LIST"} == want
    assert {r.event_id for r in out if r.decision == "SAFE_LIST"} == {r[0] for r in rows if r[2] == "10.0.0.3"}
    # totals behind the verdicts, and the same again when the last batch is sent once more
    batch = spark.createDataFrame(rows, ROW)
    expect = verdicts.engine_counters(verdicts.decide(batch, safe)).select(*TOTALS).first()
    assert run.totals(schema).first() == expect
    run.apply(spark.createDataFrame(files[-1], ROW), run.store.head()["batch"])
    assert run.totals(schema).first() == expect
    assert run.decided(schema, flush=False).count() < len(rows)


def test_late_rows_are_kept_apart(spark, tmp_path):
    safe = spark.createDataFrame([], "ip string")
    files = [[(1, T0 + timedelta(seconds=100), "a", "d", "DDOS", 0.8, 20)], [(2, T0, "a", "d", "DDOS", 0.8, 20),
             (3, T0 + timedelta(seconds=95), "a", "d", "DDOS", 0.8, 20), (4, None, "a", "d", "DDOS", 0.8, 20)], []]
    run, _ = run_files(spark, tmp_path, files, lambda: VerdictStream(spark, str(tmp_path / "t"), safe, "10 seconds"))
    schema = spark.createDataFrame([], ROW).schema
    assert [r.event_id for r in run.late(schema).collect()] == [2]
    got = {r.event_id: r.alerts_since_reset for r in run.decided(schema).collect()}
    assert got[3] in (1, 2) and got[1] >= 1 and set(got) == {1, 3, 4}


def test_state_is_merged_into_a_base(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "s"), compact=3)
    schema = spark.createDataFrame([], "k string, v long").schema
    want = {}
    for b in range(11):
        part = {f"k{(b * 3 + i) % 7}": b * 10 + i for i in range(3)} | ({None: b} if b % 4 == 0 else {})
        bases = store.change("t", spark.createDataFrame(list(part.items()), schema), ["k"], b)
        got = {r.k: r.v for r in store.state("t", schema, ["k"]).collect()}
        assert got == want, b  # not valid before the commit
        store.commit(b, bases=bases)
        want |= part
        assert {r.k: r.v for r in store.state("t", schema, ["k"]).collect()} == want, b
    assert store.head()["bases"]["t"] >= 8 and store.done(10) and not store.done(11)


def alerts_of(spark, path):
    return spark.read.format(alert_sink.register(spark)).load(path)


def test_alerts_once_per_batch(spark, tmp_path):
    """The stream's alerts equal the batch's although a batch is written twice."""
    rows, files = shuffled_files(8, 300, 3)
    safe = spark.createDataFrame([("10.0.0.3",)], "ip string")
    schema = spark.createDataFrame([], ROW).schema
    sink = str(tmp_path / "alerts")
    cls = crashing(sq._AlertingVerdicts, 1)
    run, restarts = run_files(spark, tmp_path, files, lambda: cls(spark, str(tmp_path / "t"), safe, "1000 seconds", schema, sink))
    assert restarts == 1
    done = run.decided(schema, flush=False)
    want = verdicts.alerts(done)
    got = alerts_of(spark, sink)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.count()
    value = json.loads(verdicts.alert_json(got).first()["value"])
    assert list(value) == got.columns


def test_alert_sink_of_a_stream_and_a_failed_write(spark, tmp_path):
    fmt, sink, src = alert_sink.register(spark), str(tmp_path / "alerts"), str(tmp_path / "in")
    row = (1, "a", "b", "99.0%", 5, "00:00:01", "alert", "x \n\"ü", None)
    spark.createDataFrame([row] * 3, alert_sink.SCHEMA).write.parquet(src)
    for _ in range(2):  # a new checkpoint replays batch 0
        spark.readStream.schema(alert_sink.SCHEMA).parquet(src).writeStream.format(fmt).option("path", sink) \
            .option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in alerts_of(spark, sink).collect()] == [row] * 3
    bad = spark.createDataFrame([row] * 40, alert_sink.SCHEMA).repartition(4).withColumn(
        "n_packets", F.when(F.spark_partition_id() == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("n_packets")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format(fmt).option("path", sink).option("transaction", "bad").mode("append").save()
    assert alerts_of(spark, sink).count() == 3
    manifests = {p.name for p in Path(sink, "_manifests").glob("*.json")}
    assert manifests == {"batch-0.json"}
    spark.createDataFrame([row], alert_sink.SCHEMA).write.format(fmt).option("path", sink).mode("overwrite").save()
    assert alerts_of(spark, sink).count() == 1
    assert alerts_of(spark, str(tmp_path / "nothing")).count() == 0


def test_training_run_equals_restarts_and_replay(spark):
    whole = sq.train_run(spark, SF_SMALL, restart=False)
    restarted = sq.train_run(spark, SF_SMALL, restart=True)
    rows = [model_rows(r.model()) for r in (whole, restarted)]
    assert rows[0] == rows[1] and whole.store.head()["batch"] == 2
    assert {r.version: r.n for r in whole.versions().groupBy("version").agg(F.countDistinct("model").alias("n")).collect()} == {0: 3, 1: 3, 2: 3}
    # a batch that is sent again changes nothing, and a lost coefficient is an error
    whole.apply(whole.spark.createDataFrame([], "x int"), 2)
    assert model_rows(whole.model()) == rows[0]
    from flowsieve.streaming.training import states_of
    with pytest.raises(ValueError, match="coefficients"):
        states_of(whole.store.read("model", whole.schema, 2).where("feature_index <> 3 or class_index <> 0").collect(), whole.configs)


def test_training_crash_before_commit(spark):
    calls = []

    class Once(sq.TrainingStream):
        def before_commit(self, number):
            if number == 1 and not calls:
                calls.append(number)
                raise Crash("1")
    with pytest.raises(Exception, match="Crash"):
        sq.train_run(spark, SF_SMALL, make=Once)


def test_full_batch_step_is_one_local_batch(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(200, 4)), rng.integers(0, 3, 200), rng.uniform(0.5, 2, 200)
    df = spark.createDataFrame([(a.tolist(), int(b), float(c), i) for i, (a, b, c) in enumerate(zip(x, y, w))],
                               "features array<double>, label_idx int, weight double, row_key long")
    cfgs = [sgd.SgdConfig("a", "modified_huber", "l2"), sgd.SgdConfig("b", "log_loss", "elasticnet"), sgd.SgdConfig("c", "modified_huber", "l1")]
    states = sgd.init_states(cfgs, 3, 4)
    size, sgd.BATCH = sgd.BATCH, 1000
    try:
        for _ in range(3):
            want = [sgd.local_pass(s, x, y, w) for s in states]
            states = sgd.gradient_step(df.repartition(7), states)
            for a, b in zip(states, want):
                assert np.allclose(a.w, b.w, atol=1e-12) and np.allclose(a.b, b.b, atol=1e-12) and a.t == b.t
    finally:
        sgd.BATCH = size
    assert sgd.gradient_step(df.limit(0), states) == states


def test_score_stream_equals_job_on_closed_windows(spark):
    job = {tuple(r) for r in train_queries.q_score_job(spark, SF_SMALL).collect()}
    stream = [tuple(r) for r in sq.q_score_job_stream(spark, SF_SMALL).collect()]
    end = spark.read.parquet(f"{SF_SMALL}/events.parquet").agg(F.date_trunc("day", F.max("ts")).alias("t")).first()["t"]
    closed = {r.event_id for r in spark.read.parquet(f"{SF_SMALL}/events.parquet").where(F.col("ts") < F.lit(end)).collect()}
    assert len(stream) == len(set(stream)) and set(stream) == {r for r in job if r[0] in closed}
