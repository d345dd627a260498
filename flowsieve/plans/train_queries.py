"""Training, tuning, calibration, persistence and end-to-end jobs (rows-only checks),
plus the model registry (SQL-checked)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..contract import ENSEMBLE_MEMBERS, FEATURE_ENG_VERSION
from ..functions import features as fe
from ..operators import metrics, sampling, scaling, verdicts, windows
from ..session import scratch_path, shuffle_partitions, stored
from ..sources.tables import table
from . import training
from .flow_queries import RAW, VECTOR, sql_clean, sql_derived, sql_grouped
from .model_queries import embedding_models, models_sql
from .registry import r, register, sr

q = fx.q_sql

_CACHE: dict = {}


def trained(spark, sf_dir, tune: bool = False):
    """Train once per session and table folder (coefficients are small and kept on the driver)."""
    key = (id(spark), sf_dir, tune)
    if key not in _CACHE:
        _CACHE[key] = training.train(spark, fx.load(spark, sf_dir, "flows"), tune=tune)
    return _CACHE[key]


def _metrics_out(df):
    return df.select("model", *[r(c).alias(c) for c in ("accuracy", "f1_weighted", "f1_macro")], "test_set_size")


def _first_step_sql(members) -> str:
    """One full-batch step from zero of each member, in closed form.

    At zero every margin is 0, so a row pulls class k by +-slope: the step is
    eta * slope * (2 * own - all) / rows, with ``own`` the weighted feature sum of
    the class and ``all`` that of all classes; l1 then takes off eta * alpha.
    """
    ex = {n: q(n) for n in RAW}
    ex.update({n: sql_clean(e) for n, e in sql_derived(set(RAW)).items()})
    clean = ", ".join(f"{sql_clean(q(n))} AS {q(n)}" for n in RAW)
    stats = ", ".join(f"avg({ex[n]}) AS m{i}, CASE WHEN stddev_pop({ex[n]}) = 0 THEN 1.0 ELSE stddev_pop({ex[n]}) END AS s{i}"
                      for i, n in enumerate(VECTOR))
    sums = ", ".join(f"sum(w * (({ex[n]}) - m{i}) / s{i}) AS f{i}" for i, n in enumerate(VECTOR))
    long = " UNION ALL ".join(f"SELECT g, {i} AS i, f{i} AS s FROM sums" for i in range(len(VECTOR)))
    rows = []
    for name, loss, penalty, alpha, _ in members:
        slope, start = (2.0, "typw / 4.0") if loss == "modified_huber" else (0.5, "typw")
        eta = f"(1.0 / ({alpha!r} * (1.0 + 1.0 / (({start.replace('typw', f'power({alpha!r}, -0.25)')}) * {alpha!r}))))"
        step = f"({eta} * {slope} * (2 * l.s - t.s) / n.n)"
        cut = f"CASE WHEN l.i < 0 THEN {step} ELSE sign({step}) * greatest(abs({step}) - {eta} * {alpha!r}, 0.0) END"
        rows.append(f"SELECT '{name}' AS model, k.k AS class_index, cast(l.i AS INTEGER) AS feature_index, "
                    f"{sr(cut if penalty == 'l1' else step)} AS weight "
                    "FROM long l JOIN tot t ON l.i = t.i JOIN k ON k.g = l.g, n")
    return fx.with_ctes("SELECT 1", "flows")[:-len("\nSELECT 1")] + f""",
cleaned AS (SELECT {clean}, file_id, {sql_grouped('label')} AS g FROM flows),
st AS (SELECT {stats} FROM cleaned),
nc AS (SELECT file_id, g, count(*) AS nc FROM cleaned GROUP BY 1, 2),
wt AS (SELECT file_id, g, sum(nc) OVER (PARTITION BY file_id) / (count(*) OVER (PARTITION BY file_id) * nc) AS w FROM nc),
sums AS (SELECT c.g, sum(w) AS b, {sums} FROM cleaned c JOIN wt ON wt.file_id = c.file_id AND wt.g = c.g, st GROUP BY c.g),
long AS (SELECT g, -1 AS i, b AS s FROM sums UNION ALL {long}),
tot AS (SELECT i, sum(s) AS s FROM long GROUP BY i),
k AS (SELECT g, cast(row_number() OVER (ORDER BY g) - 1 AS INTEGER) AS k FROM sums),
n AS (SELECT count(*) AS n FROM cleaned)
""" + " UNION ALL ".join(rows)


def _first_step(spark, sf_dir, members):
    """Coefficients of ``members`` after one step over all flows from zero."""
    from ..operators import linear, sgd
    flows = fx.load(spark, sf_dir, "flows")
    classes = [c["class_name"] for c in training.labels.class_scan(flows).orderBy("class_name").collect()]
    vecs = fe.add_derived_features(fe.clean_nonfinite(flows.select(*[fe.c(n) for n in RAW]), RAW))
    scaler = scaling.scaler_params(scaling.fit_scaler(vecs, VECTOR))
    rows = training._training_rows(training.keyed(training.labels.group_labels(flows)), classes, RAW, scaler, "file_id")
    configs = [sgd.SgdConfig(n, loss, pen, alpha, vote) for n, loss, pen, alpha, vote in members]
    states = sgd.gradient_step(rows.select("features", "label_idx", "weight"), sgd.init_states(configs, len(classes), len(VECTOR)))
    out = spark.createDataFrame(linear.coefficient_rows([s.to_model() for s in states]), linear.COEF_SCHEMA)
    return out.select("model", "class_index", "feature_index", r("weight").alias("weight"))


@register("sgd_ovr_fit", _first_step_sql(ENSEMBLE_MEMBERS[:1]))
def q_sgd_ovr_fit(spark, sf_dir):
    """One full-batch step of a one-vs-rest model over all flows."""
    return _first_step(spark, sf_dir, ENSEMBLE_MEMBERS[:1])


@register("ensemble_fit", _first_step_sql(ENSEMBLE_MEMBERS))
def q_ensemble_fit(spark, sf_dir):
    """One full-batch step of the three members (both losses, l2 and l1) over all flows."""
    return _first_step(spark, sf_dir, ENSEMBLE_MEMBERS)


@register("sgd_report")
def q_sgd_report(spark, sf_dir):
    """One modified_huber/l2 model fitted by rounds of local passes, evaluated per class on the test set."""
    from ..operators import sgd
    model, test = trained(spark, sf_dir)
    flows = training.keyed(training.labels.group_labels(fx.load(spark, sf_dir, "flows")))
    held = sampling.holdout_counted(flows, test.select("row_key"), "row_key")
    data = training.dealt_rows(held, model.classes, model.raw, model.scaler, "file_id", 42, shuffle_partitions(spark))
    cfg = sgd.SgdConfig("sgd_mhuber", "modified_huber", "l2", 1e-4)
    st = sgd.fit(data, sgd.init_states([cfg], len(model.classes), len(model.feature_names)), 3)[0]
    preds = training.predictions(test, [st.to_model()], model.classes, each=False)
    pc = metrics.per_class(preds, ["model"])
    return pc.select("class_name", r("precision").alias("precision"), r("recall").alias("recall"),
                     r("f1").alias("f1"), "support")


@register("ensemble_report")
def q_ensemble_report(spark, sf_dir):
    """The three-member ensemble and each member, evaluated on the held-out test set."""
    model, test = trained(spark, sf_dir)
    return _metrics_out(metrics.metrics(training.predictions(test, model.models, model.classes), ["model"]))


@register("grid_search")
def q_grid_search(spark, sf_dir):
    """Grid of 16 points scored by macro F1 on the tuning split; ``is_best`` marks the first best."""
    model, _ = trained(spark, sf_dir, tune=True)
    best = model.best_params
    rows = [(g["alpha"], g["loss"], g["penalty"], float(g["f1_macro"]), float(g["f1_weighted"]),
             g["alpha"] == best["alpha"] and g["loss"] == best["loss"] and g["penalty"] == best["penalty"])
            for g in model.grid]
    return spark.createDataFrame(rows, "alpha double, loss string, penalty string, f1_macro double, "
                                       "f1_weighted double, is_best boolean")


@register("calibrate_job")
def q_calibrate_job(spark, sf_dir):
    """Isotonic calibration per class on the last 10 % of the test set; calibrated, renormalised
    probabilities scored on the rest."""
    from ..operators import isotonic, linear
    model, test = trained(spark, sf_dir)
    split = sampling.ordered_split(test, "row_key")
    scored = stored(linear.predict(split, "features", model.models, model.classes, ["label_group", "calib_part"]), "scored")
    cal = scored.where(F.col("calib_part") == "calibration").withColumn(
        "y", F.try_element_at(training.index_map(model.classes), F.col("label_group")))
    out = isotonic.calibrate(scored.where(F.col("calib_part") == "test"), "proba", isotonic.fit(cal, "proba", "y").collect())
    names = F.array(*[F.lit(c) for c in model.classes])
    best = F.array_position("calibrated", F.array_max("calibrated")).cast("int")
    preds = out.select(F.lit("calibrated").alias("model"), F.col("label_group").alias("y"),
                       F.element_at(names, best).alias("yhat"))
    return _metrics_out(metrics.metrics(preds, ["model"]))


@register("train_job")
def q_train_job(spark, sf_dir):
    """Class scan -> scaler -> test set -> holdout -> grid -> ensemble -> evaluate -> save."""
    import datetime
    model, test = trained(spark, sf_dir, tune=True)
    path = scratch_path(spark, "model")
    counts = fx.load(spark, sf_dir, "flows").agg(F.countDistinct("file_id").alias("f"), F.count(F.lit(1)).alias("n")).first()
    meta = training.metadata(model, datetime.datetime.now().isoformat(), counts["f"], counts["n"])
    training.save(spark, model, path, meta)
    return _metrics_out(metrics.metrics(training.predictions(test, model.models, model.classes), ["model"]))


@register("sink_model", models_sql(
    f"SELECT model, k AS class_index, cast(i - 1 AS INTEGER) AS feature_index, {sr('w')} AS weight FROM coef UNION ALL "
    f"SELECT model, k, -1, {sr('b')} FROM bias"))
def q_sink_model(spark, sf_dir):
    """Models saved and loaded back, every coefficient; a lost one is an error."""
    from ..operators import linear
    models, classes = embedding_models(spark, sf_dir)
    model = training.TrainedModel([str(c) for c in classes], [], {}, models)
    path = scratch_path(spark, "model")
    training.save(spark, model, path, training.metadata(model, "", 0, 0))
    back = spark.createDataFrame(linear.coefficient_rows(training.load(spark, path).models), linear.COEF_SCHEMA)
    return back.select("model", "class_index", "feature_index", r("weight").alias("weight"))


#: Window of the scoring job in the test tables.
SCORE_WIDTH = "1 day"
_VERDICT_ROW = "event_id long, ts timestamp, src_ip string, dst_ip string, label string, confidence double, n_packets int"


def verdict_schema(spark):
    return spark.createDataFrame([], _VERDICT_ROW).schema


def verdict_rows(win, model):
    """Scored windows (with ``event_id``) as rows to decide on."""
    from ..operators import linear
    keep = ["event_id", "window_start", "src_ip", "dst_ip", "n_pk"]
    v = training.vectors(win.withColumn("n_pk", F.col("Number")), model.raw, model.scaler, keep)
    scored = linear.predict(v, "features", model.models, model.classes, keep)
    return scored.select("event_id", F.col("window_start").cast("timestamp").alias("ts"), "src_ip", "dst_ip", "label",
                         "confidence", F.col("n_pk").cast("int").alias("n_packets"))


def decided_out(decided):
    return decided.select("event_id", "src_ip", "label", r("confidence").alias("confidence"), "decision",
                          "escalated", "block_accepted")


@register("score_job")
def q_score_job(spark, sf_dir):
    """Packets -> per-source windows -> features -> scale -> vote -> decisions."""
    model, _ = trained(spark, sf_dir)
    win = windows.flow_window_features(fx.load(spark, sf_dir, "packets"), SCORE_WIDTH, keys=["src_ip"], with_event=True)
    # one row per scored window (far fewer than packets): materialise it once so the
    # decision scans do not re-run window aggregation and scoring for their sampling
    rows = stored(verdict_rows(win, model), "verdict-rows")
    return decided_out(verdicts.decide(rows, fx.load(spark, sf_dir, "safe_list")))


def registry_rows(spark, sf_dir):
    """Model artifacts: one per order (the customer is the models folder)."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").alias("models_dir"),
        F.concat(F.lit("metadata_"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit("_"),
                 F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit(".json")).alias("name"),
        F.when(F.col("o_orderstatus") == "P", "0.9.0").otherwise("1.0.0").alias("feature_eng_version"),
        F.create_map(F.lit("pkl"), F.concat(F.lit("ensemble_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"),
                                           F.lit(".pkl"))).alias("files"),
    )


def latest_model(registry, current_version: str = FEATURE_ENG_VERSION):
    """Newest artifact per folder (greatest name, ``max_by``: partial aggregation) and a version flag."""
    best = registry.groupBy("models_dir").agg(F.max_by(F.struct("name", "feature_eng_version", "files"),
                                                       F.col("name")).alias("b"))
    return best.select("models_dir", F.col("b.name").alias("name"),
                       F.col("b.feature_eng_version").alias("feature_eng_version"),
                       F.col("b.files")["pkl"].alias("pkl"),
                       (~F.col("b.feature_eng_version").eqNullSafe(F.lit(current_version))).alias("version_mismatch"))


@register("model_registry_latest", f"""
SELECT models_dir, arg_max(name, name) AS name, arg_max(v, name) AS feature_eng_version, arg_max(pkl, name) AS pkl,
  arg_max(v, name) IS DISTINCT FROM '{FEATURE_ENG_VERSION}' AS version_mismatch
FROM (SELECT o_custkey AS models_dir,
  'metadata_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || lpad(cast(o_orderkey AS VARCHAR), 12, '0') || '.json'
    AS name,
  CASE o_orderstatus WHEN 'P' THEN '0.9.0' ELSE '1.0.0' END AS v,
  'ensemble_' || lpad(cast(o_orderkey AS VARCHAR), 12, '0') || '.pkl' AS pkl FROM orders) AS r
GROUP BY models_dir""")
def q_model_registry_latest(spark, sf_dir):
    return latest_model(registry_rows(spark, sf_dir))
