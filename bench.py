"""Benchmark the headline queries.

Runs each query fully (``noop`` sink: every row is computed, nothing is sent
to the driver) at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line.  One untimed query on the
smallest tables warms the JVM first (class loading, JIT), as a long-running
cluster session would be.  Each timing includes planning, any small jobs the
query runs while planning (sampling for skew-safe scans, scaler or class-mean
fits) and the full execution.  Output:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "flow_window_features",
    "flow_window_features_by_source",
    "window_cap",
    "derive_features",
    "feature_vector",
    "fit_scaler",
    "apply_scaler",
    "group_labels",
    "stratified_cap_sample",
    "balanced_weights",
    "confusion_matrix",
    "metrics_by_model",
    "classification_report",
    "repeat_offender",
    "engine_counters",
    "audit_sample",
    "block_ledger",
    "device_inventory",
    "score_linear",
    "ensemble_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from flowsieve.plans import catalog
    from flowsieve.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        catalog.QUERIES["flow_window_features"](spark, warm).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        fn = catalog.QUERIES.get(name)
        if fn is None:
            continue
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    rows, sec, vote_sec = flow_scoring(spark, sf_dir)
    timings["flow_scoring"] = round(sec, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "flow_scoring_rows": rows,
        "flow_scoring_rows_per_sec": round(rows / sec) if sec > 0 else None,
        "flow_scoring_includes": "parquet read, cleaning, 12 derived features, scaling, 3-model soft vote, "
                                 "label and confidence per row",
        "vote_rows_per_sec": round(rows / vote_sec) if vote_sec > 0 else None,
        "vote_includes": "3-model soft vote on scaled vectors that lie in memory, label and confidence per row",
    }))


def flow_scoring(spark, sf_dir: str) -> tuple[int, float, float]:
    """Score every flow row with a 3-member one-vs-rest ensemble, end to end, and from vectors in memory.

    Models are class-mean linear models of the scaled flow vectors (one
    aggregation, not timed); the timed part reads, cleans, derives, scales and
    votes for every row (noop sink).
    """
    from pyspark.sql import functions as F

    from flowsieve import fixtures as fx
    from flowsieve.operators import labels, linear, scaling
    from flowsieve.plans import training
    from flowsieve.plans.flow_queries import RAW, VECTOR

    flows = labels.group_labels(fx.load(spark, sf_dir, "flows"))
    base = training.vectors(flows, RAW, None, ["label_group"])
    wide = base.select("label_group", *[F.col("features").getItem(i).alias(n) for i, n in enumerate(VECTOR)])
    scaler = scaling.scaler_params(scaling.fit_scaler(wide, VECTOR))
    vecs = training.vectors(flows, RAW, scaler, ["label_group"])
    means = linear.class_means(vecs, "features", "label_group", len(VECTOR))
    classes = sorted(means)
    mat = [means[c] for c in classes]
    sq = [sum(x * x for x in row) for row in mat]
    models = [linear.LinearModel("m1", "modified_huber", mat, [-0.5 * v for v in sq], 1.0),
              linear.LinearModel("m2", "log_loss", mat, [-0.5 * v for v in sq], 1.0),
              linear.LinearModel("m3", "modified_huber", [[2 * a for a in r] for r in mat], [-v for v in sq], 0.8)]
    n = flows.count()
    t0 = time.perf_counter()
    scored = linear.predict_many(vecs, "features", {"ensemble": models}, classes, ["label_group"])
    scored.write.format("noop").mode("overwrite").save()
    sec = time.perf_counter() - t0
    held = vecs.cache()
    held.count()
    t0 = time.perf_counter()
    linear.predict_many(held, "features", {"ensemble": models}, classes, ["label_group"]) \
        .write.format("noop").mode("overwrite").save()
    return n, sec, time.perf_counter() - t0


if __name__ == "__main__":
    main()
