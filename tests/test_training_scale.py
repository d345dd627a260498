"""The training path on rows of its own: what is drawn, what moves, and what is computed more than once."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve import fixtures as fx
from flowsieve.functions import permute
from flowsieve.operators import sampling, selection, sgd
from flowsieve.plans import stream_queries as sq
from flowsieve.plans import train_queries, training

RAW = ["Rate", "Max", "Min"]
SCALER = {"Rate": (2.0, 3.0)}


def flow_rows(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), float(rng.randrange(9)), float(rng.randrange(5)), 1.0, rng.choice(["a", "b", "c", None])) for _ in range(n)]
    rows += rows[:n // 2] + rows[:n // 4]  # equal rows, up to three of each and more by chance
    return training.keyed(spark.createDataFrame(rows, "file_id int, Rate double, Max double, Min double, label_group string").repartition(5))


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("per_file, per_class", [(7, 5), (50, 11), (1000, 1000)])
def test_rows_of_a_narrow_sample_are_the_rows_of_the_whole_one(spark, per_file, per_class):
    df = flow_rows(spark)
    args = ("file_id", "row_key", "label_group", per_file, per_class, ["a", "b"])
    keys = sampling.copies(sampling.stratified_cap_sample(df.select("file_id", "row_key", "label_group"), *args), "row_key")
    want = Counter(map(tuple, sampling.stratified_cap_sample(df, *args).collect()))
    assert Counter(map(tuple, sampling.rows_of(df, keys, "row_key").collect())) == want and want


def test_first_rows_of_large_caps_move_no_row_before_the_cut(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    cut = selection.up_to_bin(df, ["g"], ["v"], selection.BROADCAST_FROM)
    assert plan_of(cut).count("strategy=broadcast") == 2
    got = {(r.g, r.v, r.rn) for r in selection.first_k(df, ["g"], ["v"], selection.BROADCAST_FROM).collect()}
    by_key = {g: sorted(i * 7919 % 5003 for i in range(5000) if i % 2 == g) for g in (0, 1)}
    assert got == {(g, v, i + 1) for g, vs in by_key.items() for i, v in enumerate(vs[:selection.BROADCAST_FROM])}


@pytest.mark.parametrize("few", [0, 1000])
def test_dealt_rows_travel_raw_and_equal_dealt_vectors(spark, monkeypatch, few):
    monkeypatch.setattr(sampling, "SMALL_ROWS", few)
    df, classes = flow_rows(spark), ["a", "b"]
    dealt = training.dealt_rows(df, classes, RAW, SCALER, "file_id", 42, 4)
    v = training.vectors(df.where(F.col("label_group").isin(*classes)), RAW, SCALER, ["row_key", "label_group", "file_id"])
    v = v.withColumn("label_idx", F.try_element_at(training.index_map(classes), "label_group"))
    want = sgd.prepare(sampling.balanced_weights(v, "file_id", "label_group"), "features", "label_idx", "weight", "row_key", 42, 4)
    part = F.spark_partition_id().alias("part")
    got = [tuple(r) for r in dealt.select("features", "label_idx", "weight", part).collect()]
    assert got == [tuple(r) for r in want.select("*", part).collect()] and got
    moved = plan_of(dealt)
    assert "AS features" in moved.split("RepartitionByExpression")[0] and "AS features" not in moved.split("RepartitionByExpression")[1]
    assert moved.count("strategy=broadcast") == (1 if few else 0)


def test_fit_reads_its_rows_once_and_equals_local_passes(spark):
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(700, 3)), rng.integers(0, 2, 700), rng.uniform(0.5, 2, 700)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    schema = "features array<double>, label_idx int, weight double"
    df = spark.createDataFrame([(a.tolist(), int(b), float(c)) for a, b, c in zip(x, y, w)], schema).coalesce(1).mapInArrow(count, schema)
    cfgs = [sgd.SgdConfig("a", "modified_huber", "l2"), sgd.SgdConfig("b", "log_loss", "elasticnet")]
    got = sgd.fit(df, sgd.init_states(cfgs, 2, 3), 3)
    want = sgd.init_states(cfgs, 2, 3)
    for _ in range(3):
        want = [sgd.local_pass(s, x, y, w) for s in want]
    assert all(np.allclose(a.w, b.w, rtol=1e-12) and np.allclose(a.b, b.b, rtol=1e-12) and a.t == b.t for a, b in zip(got, want))
    assert read.value == 700


def test_rounds_hand_python_a_few_blocks_at_once_and_keep_them_out_of_the_heap(spark, monkeypatch):
    """All blocks of a partition, up to 64 MB, came as one batch, held by the executor beside its heap and by the worker."""
    batches_in, bytes_in = (spark.sparkContext.accumulator(0) for _ in range(2))
    levels, whole, one_round = [], sgd._round_fn, sgd._one_round

    def watched(states):
        run = whole(states)

        def count(batches):
            for b in batches:
                batches_in.add(1)
                bytes_in.add(b.nbytes)
                yield b
        return lambda batches: run(count(batches))
    monkeypatch.setattr(sgd, "_round_fn", watched)
    monkeypatch.setattr(sgd, "_one_round", lambda blocks, states: levels.append(blocks.storageLevel) or one_round(blocks, states))
    rows = spark.range(0, 100_000, numPartitions=1).select(
        F.array(*[F.rand(i) for i in range(40)]).alias("features"), (F.col("id") % 2).cast("int").alias("label_idx"), F.lit(1.0).alias("weight"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    state = sgd.fit(rows, sgd.init_states([sgd.SgdConfig("a")], 2, 40), 1)[0]
    assert state.t == 1 + 10 * -(-10_000 // sgd.BATCH)  # ten blocks of 10,000 rows, as without the bound
    assert bytes_in.value > 24 << 20 and bytes_in.value / batches_in.value <= 3 << 22
    assert levels and not levels[0].useMemory and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def lineitems(spark, path, files=6, rows=600):
    i = F.col("id")
    (spark.range(rows).select(F.floor(i / 4).alias("l_orderkey"), (i * 37 % 200).alias("l_partkey"), (i * 11 % 100).alias("l_suppkey"),
                              (i % 4 + 1).cast("int").alias("l_linenumber"), (i % 50 + 1).cast("double").alias("l_quantity"),
                              (900.0 + i * 97 % 90000).alias("l_extendedprice"), (i % 9 / 100).alias("l_tax"))
     .repartition(files).write.parquet(f"{path}/lineitem.parquet"))
    return str(path)


def test_grid_search_is_given_stored_rows(spark, tmp_path, monkeypatch):
    """The plan of the tuning sample holds no scan of the flow table; with the sample's whole lineage in it the driver ran out of memory."""
    seen = []
    whole = training.grid_search
    monkeypatch.setattr(training, "grid_search", lambda s, sample, *a, **k: seen.append(plan_of(sample)) or whole(s, sample, *a, **k))
    flows = fx.load(spark, lineitems(spark, tmp_path), "flows")
    model, test = training.train(spark, flows, rows_per_file=20, max_rows_per_class=15, tuning_files=2, tuning_rows_per_file=30)
    assert seen and seen[0].count("Relation") == 1 and "Join" not in seen[0]
    assert len(model.grid) == 16 and test.count() > 0


def test_flow_csv_has_as_many_files_as_the_table_has_parts(spark, tmp_path):
    monkey = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "20000")
    try:
        sf = lineitems(spark, tmp_path)
        out = sq._write_flow_csv(spark, sf)
        assert len(spark.read.text(out).inputFiles()) >= 6
        want = Counter(map(tuple, fx.load(spark, sf, "flows").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", monkey)
    assert Counter(map(tuple, sq.q_src_flow_csv(spark, sf).collect())) == want


def test_scored_windows_are_stored_before_they_are_judged(spark, monkeypatch):
    """Reading a streaming batch several times would aggregate it and write its state every time."""
    from conftest import SF_SMALL
    seen = []
    whole = sq.VerdictStream.apply
    monkeypatch.setattr(sq.VerdictStream, "apply", lambda self, batch, n: seen.append(plan_of(batch)) or whole(self, batch, n))
    model, _ = train_queries.trained(spark, SF_SMALL)
    sq.score_stream(spark, SF_SMALL, model, sq._packet_stream(spark, SF_SMALL), sq.scratch_path(spark, "t"), "0 seconds", sq.scratch_path(spark, "c"))
    assert seen and all("Relation" in p and "Aggregate" not in p and "LogicalRDD" not in p for p in seen)


def test_open_windows_of_the_scoring_stream_are_not_kept_in_the_heap(spark):
    """Windows of all sources are open at once; as Java objects they outgrew the executors."""
    from conftest import SF_SMALL
    key = "spark.sql.streaming.stateStore.providerClass"
    model, _ = train_queries.trained(spark, SF_SMALL)
    ckpt = sq.scratch_path(spark, "c")
    run = sq.score_stream(spark, SF_SMALL, model, sq._packet_stream(spark, SF_SMALL), sq.scratch_path(spark, "t"), "0 seconds", ckpt)
    logged = "".join(r.value for r in spark.read.text(f"{ckpt}/offsets").collect())
    assert "RocksDBStateStoreProvider" in logged and "RocksDB" not in spark.conf.get(key, "")
    assert run.decided(train_queries.verdict_schema(spark)).count() > 0


def test_places_run_on_batches_and_equal_a_loop(spark):
    def loop(i, n, key, rounds=permute.ROUNDS):
        p = permute.PRIME

        def hashed(v, r):
            t = (v % p * permute.A + key * permute.B + r * permute.C + 12345) % p
            t = (t * permute.A + (t >> 7)) % p
            return (t ^ (t >> 13)) * permute.B % p
        for r in range(rounds):
            partner = (hashed(0, r) % n - i) % n
            i = partner if (hashed(max(i, partner) + 1, r) >> 11) & 1 else i
        return i
    rows = [(i, n, k) for n, k in ((1, 5), (250, 42), (7, 2**31 - 2), (2**31 - 1, 9)) for i in range(min(n, 60))]
    df = spark.createDataFrame([*rows, (None, 5, 1)], "i long, n long, k long")
    out = df.select("*", permute.place(F.col("i"), F.col("n"), F.col("k")).alias("p"))
    assert "lambda" not in plan_of(out)
    assert {(r.i, r.n, r.k): r.p for r in out.collect()} == {**{x: loop(*x) for x in rows}, (None, 5, 1): None}
