"""Source and streaming queries: flow CSV files and folders, the packet stream, windowed
features, stateful verdicts, live counters, carry-over windows, incremental training."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import carry, verdicts
from ..session import scratch_path, stored
from ..sources import alert_sink, flow_csv
from ..sources.tables import table
from ..streaming import packets as st
from ..streaming.training import TrainingStream
from ..streaming.verdicts import VerdictStream
from .packet_queries import GLOBAL_WIDTH, _window_out, _window_sql, window_body
from .registry import register, sql_ts_text, ts_text
from .verdict_queries import _COUNTER_SQL, _decide_sql

_FLOW_COLS = [n for n, _ in fx.FLOWS]
_PADDED = {"label": " label ", "Rate": "Rate "}     # headers written with stray blanks


def _spread_flows(spark, sf_dir, least: int):
    """Flow rows dealt evenly, while they are narrow, over as many parts as their table is read in, ``least`` at least; and how many."""
    base = table(spark, sf_dir, "lineitem")
    parts = max(least, base.rdd.getNumPartitions())
    return fx.PROJECTIONS["flows"].apply(base.repartition(parts)), parts


def _write_flow_csv(spark, sf_dir, n_files: int = 4) -> str:
    flows, _ = _spread_flows(spark, sf_dir, n_files)
    out = flows.select(*[F.col(f"`{c}`").alias(_PADDED.get(c, c)) for c in flows.columns])
    path = scratch_path(spark, "flow-csv")
    (out.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@register("src_flow_csv", fx.with_ctes("SELECT * FROM flows", "flows"))
def q_src_flow_csv(spark, sf_dir):
    """Write the flow table as CSV files, then read the listed files back with trimmed headers."""
    path = _write_flow_csv(spark, sf_dir)
    files = [r["path"] for r in flow_csv.list_files(spark, path).orderBy("path").collect()]
    df = flow_csv.read_flow_csv(spark, files, numeric=["file_id"])
    return df.select(*[F.col(f"`{c}`") for c in _FLOW_COLS])


@register("src_flow_dir", fx.with_ctes("SELECT * FROM flows", "flows"))
def q_src_flow_dir(spark, sf_dir):
    """Read every ``*.csv`` of a folder (in name order)."""
    path = _write_flow_csv(spark, sf_dir)
    df = flow_csv.read_flow_dir(spark, path, numeric=["file_id"])
    return df.select(*[F.col(f"`{c}`") for c in _FLOW_COLS])


# -- streams -----------------------------------------------------------------

def _events_stream(spark, sf_dir, max_files=None):
    schema = table(spark, sf_dir, "events").schema
    return st.read_stream(spark, sf_dir, "events.parquet", schema, max_files)


def _packet_stream(spark, sf_dir):
    return st.event_time(fx.PROJECTIONS["packets"].apply(_events_stream(spark, sf_dir)))


def _run(stream_df, spark, name: str, mode: str = "append"):
    """Run a streaming query to the end of the available input, into a parquet table."""
    path = scratch_path(spark, name)
    ckpt = scratch_path(spark, name + "-checkpoint")
    if mode == "append":
        q = (stream_df.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
    else:
        def snapshot(batch, batch_id):
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(path)
        q = (stream_df.writeStream.foreachBatch(snapshot).option("checkpointLocation", ckpt)
             .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(path)


_PACKET_COLS = [n for n, _ in fx.PACKETS]


@register("packet_stream_source", fx.with_ctes(
    "SELECT " + ", ".join(sql_ts_text("ts") + " AS ts" if c == "ts" else c for c in _PACKET_COLS)
    + " FROM packets", "packets"))
def q_packet_stream_source(spark, sf_dir):
    """Decoded packet records read as a stream (parquet files arriving in a folder)."""
    out = _run(_packet_stream(spark, sf_dir), spark, "packets-stream")
    return out.select(*[ts_text("ts").alias("ts") if c == "ts" else F.col(c) for c in _PACKET_COLS])


@register("flow_windows_stream", _window_sql("hour", [], closed_only=True))
def q_flow_windows_stream(spark, sf_dir):
    """Window features on the packet stream; closed windows only (watermark)."""
    out = _run(st.flow_windows_stream(_packet_stream(spark, sf_dir), GLOBAL_WIDTH, "0 seconds"), spark, "windows-stream")
    return _window_out(out, [])


#: Files of the verdict streams, arriving out of order: an event arrives up to four days after its time.
ARRIVALS, DELAY = 3, "5 days"
_ARRIVAL = "unix_micros(cast(ts as timestamp)) + (event_id % 5) * 86400000000L"


class _AlertingVerdicts(VerdictStream):
    """Decisions whose alerts go to the alert sink, one transaction per batch."""

    def __init__(self, spark, root, safe, delay, schema, sink_path):
        super().__init__(spark, root, safe, delay)
        self.schema, self.sink, self.sink_path = schema, alert_sink.register(spark), sink_path

    def before_commit(self, number):
        (verdicts.alerts(self.batch_decisions(self.schema, number)).write.format(self.sink).option("path", self.sink_path)
         .option("transaction", f"batch-{number}").mode("append").save())


def verdict_run(spark, sf_dir, root=None, make=VerdictStream):
    """All verdict rows through the stream, out of order, stopped and restarted after each arrival; (stream, schema)."""
    rows = fx.load(spark, sf_dir, "verdict_in").withColumn("__arrival", F.expr(_ARRIVAL))
    ends = rows.agg(F.min("__arrival").alias("lo"), F.max("__arrival").alias("hi")).first()
    width = max(1, ((ends["hi"] or 0) - (ends["lo"] or 0)) // ARRIVALS + 1)
    rows = rows.withColumn("__part", F.expr(f"cast((__arrival - {ends['lo'] or 0}L) div {width}L as int)"))
    src, root, ckpt = (scratch_path(spark, f"verdict-{x}") for x in ("in", "tables", "checkpoint"))
    safe = fx.load(spark, sf_dir, "safe_list")
    for part in range(ARRIVALS):
        rows.where(F.col("__part") == part).drop("__arrival", "__part").write.mode("append").parquet(src)
        schema = spark.read.parquet(src).schema
        run = make(spark, root, safe, DELAY)
        (spark.readStream.schema(schema).parquet(src).writeStream.foreachBatch(run.apply)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
    return run, schema


@register("verdict_stream", _decide_sql(
    "SELECT event_id, src_ip, decision, alerts_since_reset, escalated, block_accepted FROM decided "
    "WHERE decision <> 'SAFE_LIST'"))
def q_verdict_stream(spark, sf_dir):
    """Ladder, repeat counter and block ledger over files out of order, with a restart after each."""
    run, schema = verdict_run(spark, sf_dir)
    return run.decided(schema).where(F.col("decision") != "SAFE_LIST").select(
        "event_id", "src_ip", "decision", "alerts_since_reset", "escalated", "block_accepted")


@register("running_counters_stream", _decide_sql(_COUNTER_SQL))
def q_running_counters_stream(spark, sf_dir):
    """Live totals behind the verdicts, over files out of order, with a restart after each."""
    run, schema = verdict_run(spark, sf_dir)
    return run.totals(schema)


def _carry_sql() -> str:
    """Recursive walk over each source's hourly windows: carry until >= 3 packets, then close; features from the packets."""
    source = ("SELECT p.*, g.g AS w, 1 AS rk FROM packets p JOIN walk g "
              "ON g.k = p.src_ip AND g.ws = date_trunc('hour', p.ts)")
    body = f"""
w AS (SELECT src_ip AS k, date_trunc('hour', ts) AS ws, count(*) AS n,
        row_number() OVER (PARTITION BY src_ip ORDER BY date_trunc('hour', ts)) AS i
      FROM packets GROUP BY src_ip, date_trunc('hour', ts)),
walk AS (
  SELECT k, i, ws AS g, ws, n FROM w WHERE i = 1
  UNION ALL
  SELECT w.k, w.i, CASE WHEN p.n >= 3 THEN w.ws ELSE p.g END, w.ws, CASE WHEN p.n >= 3 THEN w.n ELSE p.n + w.n END
  FROM walk p JOIN w ON w.k = p.k AND w.i = p.i + 1),
ends AS (SELECT k, {sql_ts_text('g')} AS first, {sql_ts_text('max(ws) + INTERVAL 1 hour')} AS last FROM walk GROUP BY k, g)
SELECT f.window_start AS window_first_start, ends.last AS window_end, f.* EXCLUDE (window_start)
FROM ({window_body('hour', ['src_ip'], source=source)}) f
JOIN ends ON ends.k = f.key_src_ip AND ends.first = f.window_start"""
    head = fx.with_ctes("SELECT 1", "packets")[:-len("\nSELECT 1")]
    return "WITH RECURSIVE " + head[len("WITH "):] + "," + body


@register("carry_over_windows", _carry_sql())
def q_carry_over_windows(spark, sf_dir):
    """Windows under three packets roll into the next (per source, 1-hour windows): all 37 features."""
    out = carry.carry_over_windows(fx.load(spark, sf_dir, "packets"), GLOBAL_WIDTH, keys=["src_ip"])
    text = out.withColumn("window_start", F.col("window_first_start"))
    return _window_out(text, ["src_ip"], [ts_text("window_end").alias("window_end")]) \
        .withColumnRenamed("window_start", "window_first_start")


@register("incremental_train_stream")
def q_incremental_train_stream(spark, sf_dir):
    """Flow files arriving one after the other update the stored models, with a restart after each; version = batch."""
    run = train_run(spark, sf_dir)
    return run.versions().groupBy("version", "model").agg(
        F.count(F.lit(1)).alias("n_coefficients"), F.max("steps").alias("steps"), F.sum(F.abs("weight")).alias("l1_norm"))


#: Arrivals of the training stream, and the least files of each.
FILES, FILE_PARTS = 3, 4


def train_run(spark, sf_dir, restart: bool = True, make=TrainingStream, files: int = FILES):
    """The training stream over flow files, in one run or with a restart after each file."""
    from . import train_queries, training
    model, _ = train_queries.trained(spark, sf_dir)
    flows, file_parts = _spread_flows(spark, sf_dir, FILE_PARTS)
    src, root, ckpt = (scratch_path(spark, f"train-{x}") for x in ("in", "models", "checkpoint"))

    def vectors(batch, seed, partitions):
        keyed = training.keyed(training.labels.group_labels(batch))
        return training.dealt_rows(keyed, model.classes, model.raw, model.scaler, "file_id", seed, partitions,
                                   keyed.select("file_id", "label_group"))

    def go(limit):
        run = make(spark, root, training.member_configs(model.best_params), len(model.classes),
                   len(model.feature_names), vectors, 3)
        stream = spark.readStream.schema(flows.schema)
        (stream.option("maxFilesPerTrigger", limit) if limit else stream).parquet(src).writeStream \
            .foreachBatch(run.apply).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
        return run

    for part in range(files):
        flows.where(F.col("file_id") % files == part).write.mode("append").parquet(src)
        if restart or part == files - 1:
            run = go(None if restart else file_parts)
    return run


def score_stream(spark, sf_dir, model, packets, root, delay: str, checkpoint: str):
    """Packets -> windows -> vote -> decisions as one streaming query; runs to the end of the input."""
    from . import train_queries
    run = VerdictStream(spark, root, fx.load(spark, sf_dir, "safe_list"), "0 seconds")
    windows = st.flow_windows_stream(packets, train_queries.SCORE_WIDTH, delay, ["src_ip"], with_event=True)

    def step(batch, number):
        # windows close in the order of the watermark, so no row has to wait for an earlier one;
        # the rows are stored, as every further reading would aggregate and write the state again
        run.apply(stored(train_queries.verdict_rows(batch, model), "scored-windows"), number)

    # a window of every source is open at once
    with st.state_on_disk(spark):
        query = windows.writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start()
    query.awaitTermination()
    return run


@register("score_job_stream")
def q_score_job_stream(spark, sf_dir):
    """The scoring job over a packet stream: decisions on closed windows."""
    from . import train_queries
    model, _ = train_queries.trained(spark, sf_dir)
    run = score_stream(spark, sf_dir, model, _packet_stream(spark, sf_dir), scratch_path(spark, "score-tables"),
                       "0 seconds", scratch_path(spark, "score-checkpoint"))
    rows = train_queries.verdict_schema(spark)
    return train_queries.decided_out(run.decided(rows))
