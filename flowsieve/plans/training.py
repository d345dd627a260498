"""Training and scoring compositions built from the operators.

``train`` mirrors the tool's training run: class scan -> scaler (on all
rows) -> stratified test set -> training rows exclude the test rows (fixing
the tool's leak) -> optional grid search -> ensemble fit -> evaluation ->
save.  Everything that touches rows is a Spark job; the driver only holds
class lists, scaler parameters and coefficients (bounded by the model).
"""

from __future__ import annotations

import json

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import (DERIVED_FEATURES, ENSEMBLE_MEMBERS, EPOCHS_PER_CHUNK, FEATURE_ENG_VERSION,
                        GRID_ALPHAS, GRID_DEFAULT, GRID_LOSSES, GRID_PASSES, GRID_PENALTIES,
                        TEST_MAX_ROWS_PER_CLASS, TEST_ROWS_PER_FILE, TUNING_FILES, TUNING_ROWS_PER_FILE)
from ..functions import features as fe
from ..operators import labels, linear, metrics, sampling, scaling, sgd
from ..operators.profile import detect_columns
from ..session import shuffle_partitions, stored


@dataclass
class TrainedModel:
    classes: list[str]
    raw: list[str]
    scaler: dict[str, tuple[float, float]]
    models: list[linear.LinearModel]
    best_params: dict = field(default_factory=dict)
    grid: list[dict] = field(default_factory=list)

    @property
    def feature_names(self) -> list[str]:
        return list(self.raw) + list(DERIVED_FEATURES)


def keyed(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Add a deterministic row key (hash of the whole row) for tables without one."""
    return df.withColumn(name, F.xxhash64(*[fe.c(c) for c in df.columns]))


def vectors(df: DataFrame, raw: list[str], scaler: dict | None, keep: list[str]) -> DataFrame:
    """Clean -> derived features -> (scale) -> ``features`` array in the canonical order."""
    cleaned = fe.clean_nonfinite(df.select(*keep, *[fe.c(n) for n in raw]), raw)
    full = fe.add_derived_features(cleaned)
    names = list(raw) + list(DERIVED_FEATURES)
    if scaler:
        full = scaling.apply_scaler(full, scaler)
    return full.select(*keep, fe.feature_vector(names).alias("features"))


def index_map(classes: list[str]):
    return F.create_map(*chain.from_iterable((F.lit(c), F.lit(i)) for i, c in enumerate(classes)))


def member_configs(best: dict | None = None) -> list[sgd.SgdConfig]:
    cfgs = [sgd.SgdConfig(n, loss, pen, alpha, vw) for n, loss, pen, alpha, vw in ENSEMBLE_MEMBERS]
    if best and best.get("loss") == "modified_huber":
        cfgs[0] = sgd.SgdConfig(cfgs[0].name, cfgs[0].loss, best["penalty"], best["alpha"], cfgs[0].vote_weight)
    return cfgs


def grid_configs() -> list[sgd.SgdConfig]:
    out = []
    for a in GRID_ALPHAS:
        for loss in GRID_LOSSES:
            for pen in GRID_PENALTIES:
                out.append(sgd.SgdConfig(f"grid{len(out):02d}_{loss}_{pen}", loss, pen, a))
    return out


def predictions(df: DataFrame, models: list[linear.LinearModel], classes: list[str],
                y: str = "label_group", keep: list[str] | None = None, each: bool = True) -> DataFrame:
    """``(model, y, yhat)`` rows for the ensemble and (optionally) each member, in one pass."""
    keep = list(keep or [])
    groups = {"ensemble": models}
    if each:
        groups.update({m.name: [m] for m in models})
    out = linear.predict_many(df, "features", groups, classes, [y, *keep])
    return out.select("model", F.col(y).alias("y"), F.col("label").alias("yhat"), *keep)


def _weighted_rows(df: DataFrame, classes: list[str], raw: list[str], chunk: str, counted: DataFrame | None = None) -> DataFrame:
    """``row_key, label_idx, weight`` and the raw features.

    ``counted`` is a cheaper frame with the ``chunk`` and ``label_group`` of the same rows.
    """
    # null and unknown labels go before the weights are balanced
    known = [x.withColumn("label_idx", F.try_element_at(index_map(classes), F.col("label_group"))).where(F.col("label_idx").isNotNull())
             for x in (df, df if counted is None else counted)]
    weights = stored(sampling.class_weights(known[1].select(chunk, "label_group"), chunk, "label_group"), "class-weights")
    rows = known[0].select("row_key", "label_group", F.col(chunk).alias("__chunk"), "label_idx", *[fe.c(n) for n in raw])
    weights = weights.withColumnRenamed(chunk, "__chunk")
    return sampling.join_counted(rows, weights, ["__chunk", "label_group"], "left").drop("__chunk", "label_group")


def _training_rows(df: DataFrame, classes: list[str], raw: list[str], scaler: dict, chunk: str) -> DataFrame:
    return vectors(_weighted_rows(df, classes, raw, chunk), raw, scaler, ["row_key", "label_idx", "weight"])


def dealt_rows(df: DataFrame, classes: list[str], raw: list[str], scaler: dict, chunk: str, seed: int, num_partitions: int,
               counted: DataFrame | None = None) -> DataFrame:
    """Training vectors in the order of ``sgd.prepare``; the raw features travel, vectors are built where they arrive."""
    rows = sgd.deal(_weighted_rows(df, classes, raw, chunk, counted), F.col("row_key"), seed, num_partitions)
    return vectors(rows, raw, scaler, ["label_idx", "weight"])


def grid_search(spark: SparkSession, sample: DataFrame, classes: list[str], raw: list[str], scaler: dict,
                order: str = "__order", passes: int = GRID_PASSES,
                seed: int = 42) -> tuple[dict, list[dict]]:
    """Every grid point trained in the same ``passes``; macro F1 on the held-out 20 %; the first best wins."""
    # the tuning sample is bounded by files x rows_per_file: materialise it once
    # in the shared folder instead of recomputing its lineage
    split = stored(sampling.ordered_split(sample, order, 0.8).drop(order), "tuning-split")
    train = split.where(F.col("tune_part") == "train").withColumn("__one", F.lit(0))
    val = split.where(F.col("tune_part") == "val")
    data = dealt_rows(train, classes, raw, scaler, "__one", seed, shuffle_partitions(spark))
    cfgs = grid_configs()
    states = sgd.init_states(cfgs, len(classes), len(raw) + len(DERIVED_FEATURES))
    states = sgd.fit(data, states, passes)
    vv = vectors(val, raw, scaler, ["label_group"])
    groups = {st.config.name: [st.to_model()] for st in states}
    preds = linear.predict_many(vv, "features", groups, classes, ["label_group"]).select(
        "model", F.col("label_group").alias("y"), F.col("label").alias("yhat"))
    scores = {r["model"]: r for r in metrics.metrics(preds, ["model"]).collect()}
    results, best, best_f1 = [], None, -1.0
    for c in cfgs:
        r = scores[c.name]
        results.append({"alpha": c.alpha, "loss": c.loss, "penalty": c.penalty,
                        "f1_macro": r["f1_macro"], "f1_weighted": r["f1_weighted"], "passes": passes})
        if r["f1_macro"] > best_f1:
            best_f1, best = r["f1_macro"], {"alpha": c.alpha, "loss": c.loss, "penalty": c.penalty}
    return best or dict(GRID_DEFAULT), results


def train(spark: SparkSession, flows: DataFrame, file_col: str = "file_id", tune: bool = True,
          epochs: int = EPOCHS_PER_CHUNK, rows_per_file: int = TEST_ROWS_PER_FILE,
          max_rows_per_class: int = TEST_MAX_ROWS_PER_CLASS, seed: int = 42, tuning_files: int = TUNING_FILES,
          tuning_rows_per_file: int = TUNING_ROWS_PER_FILE) -> tuple[TrainedModel, DataFrame]:
    """Returns the trained model and the test-set vectors used to evaluate it.

    The scaler is fitted on all rows.  The test set (rows per file and class) and
    the tuning sample (files, rows per file) are samples by their nature; their
    sizes are arguments.  Both are drawn from stored keys (file, row key, class), and
    only the rows of the drawn keys are fetched; the keys are broadcast.
    """
    roles = detect_columns(flows.schema)
    raw = roles.features
    df = keyed(labels.group_labels(flows, roles.label))
    classes = [r["class_name"] for r in labels.class_scan(flows, roles.label).orderBy("class_name").collect()]
    stats = scaling.fit_scaler(fe.add_derived_features(fe.clean_nonfinite(df.select(*[fe.c(n) for n in raw]), raw)),
                               list(raw) + list(DERIVED_FEATURES))
    scaler = scaling.scaler_params(stats)
    keys = stored(df.select(file_col, "row_key", "label_group"), "row-keys")
    head = stored(sampling.head_per_file(keys, file_col, "row_key", rows_per_file).drop("rn"), "test-head")
    test_keys = stored(sampling.copies(sampling.stratified_cap_sample(head, file_col, "row_key", "label_group", rows_per_file,
                                                                      max_rows_per_class, classes), "row_key"), "test-keys")
    # the test set is bounded by classes x max_rows_per_class rows; evaluation,
    # calibration and reports reuse it, so it is stored
    test_vectors = stored(vectors(sampling.rows_of(df, test_keys, "row_key"), raw, scaler, ["row_key", "label_group", file_col]),
                          "test-vectors")
    train_rows, train_keys = (sampling.holdout_counted(x, test_keys, "row_key") for x in (df, keys))
    best, grid = dict(GRID_DEFAULT), []
    if tune:
        drawn = sampling.tuning_sample(train_keys, file_col, "row_key", tuning_files, tuning_rows_per_file, seed)
        picks = stored(sampling.pick_files(train_keys, file_col, tuning_files, seed), "tuning-files")
        sample = sampling.rows_of(train_rows, stored(sampling.copies(drawn, "row_key"), "tuning-keys"), "row_key")
        sample = stored(sample.join(F.broadcast(picks), file_col), "tuning-rows").withColumn("__order", F.struct("pick_rank", "row_key"))
        best, grid = grid_search(spark, sample, classes, raw, scaler, seed=seed)
    data = dealt_rows(train_rows, classes, raw, scaler, file_col, seed, shuffle_partitions(spark), train_keys)
    states = sgd.fit(data, sgd.init_states(member_configs(best), len(classes), len(raw) + len(DERIVED_FEATURES)),
                     epochs)
    model = TrainedModel(classes, raw, scaler, [s.to_model() for s in states], best, grid)
    return model, test_vectors


def metadata(model: TrainedModel, created_at: str, total_files: int, total_rows: int) -> dict:
    return {
        "model_type": "ensemble (soft voting)",
        "ensemble_config": {m.name: {"loss": m.loss, "weight": m.vote_weight} for m in model.models},
        "created_at": created_at,
        "feature_names": model.raw,
        "feature_eng_version": FEATURE_ENG_VERSION,
        "raw_feature_names": model.raw,
        "derived_feature_names": list(DERIVED_FEATURES),
        "all_feature_names": model.feature_names,
        "total_features": len(model.feature_names),
        "epochs_per_chunk": EPOCHS_PER_CHUNK,
        "class_names": model.classes,
        "n_features": len(model.feature_names),
        "n_classes": len(model.classes),
        "total_files": total_files,
        "total_rows": total_rows,
        "best_params": model.best_params,
    }


def save(spark: SparkSession, model: TrainedModel, path: str, meta: dict) -> dict:
    """Coefficients, scaler and label index as parquet; metadata as JSON (written by Spark)."""
    files = {"coefficients": f"{path}/coefficients", "scaler": f"{path}/scaler",
             "label_index": f"{path}/label_index", "metadata": f"{path}/metadata"}
    spark.createDataFrame(linear.coefficient_rows(model.models), linear.COEF_SCHEMA) \
        .write.mode("overwrite").parquet(files["coefficients"])
    spark.createDataFrame([(n, float(m), float(s)) for n, (m, s) in model.scaler.items()],
                          "feature string, mean double, scale double").write.mode("overwrite").parquet(files["scaler"])
    spark.createDataFrame(list(enumerate(model.classes)), "class_index int, class_name string") \
        .write.mode("overwrite").parquet(files["label_index"])
    meta = dict(meta, files=files)
    spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(files["metadata"])
    return files


def load(spark: SparkSession, path: str) -> TrainedModel:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    coefs = linear.models_from_rows(spark.read.parquet(f"{path}/coefficients").collect())
    order = {n: i for i, n in enumerate(meta["ensemble_config"])}
    coefs.sort(key=lambda m: order.get(m.name, 99))
    scaler = {r["feature"]: (r["mean"], r["scale"]) for r in spark.read.parquet(f"{path}/scaler").collect()}
    classes = [r["class_name"] for r in spark.read.parquet(f"{path}/label_index").orderBy("class_index").collect()]
    return TrainedModel(classes, meta["raw_feature_names"], scaler, coefs, meta.get("best_params", {}))
