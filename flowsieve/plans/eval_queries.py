"""Evaluation queries over the predictions table: confusion matrices, metrics, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import metrics as mt
from ..session import scratch_path
from .registry import r, register, sr

MODELS = [m for m, _ in fx.PRED_MODELS]

# -- SQL twins ----------------------------------------------------------------

_COUNTS = "counts AS (SELECT model, y AS y_true, yhat AS y_pred, count(*) AS n FROM preds GROUP BY 1, 2, 3)"
_STATS = """st AS (SELECT model, class_name, cast(sum(tp) AS double) AS tp, cast(sum(support) AS BIGINT) AS support,
  cast(sum(predicted) AS double) AS predicted FROM (
  SELECT model, y_true AS class_name, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted
  FROM counts UNION ALL SELECT model, y_pred, 0, 0, n FROM counts) AS s GROUP BY 1, 2)"""
_PC = """pc AS (SELECT model, cast(row_number() OVER (PARTITION BY model ORDER BY class_name) - 1 AS INTEGER) AS class_id,
  class_name,
  CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
  CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * tp / (predicted + support) END AS f1,
  support, tp FROM st)"""
_OV = """ov AS (SELECT model, sum(tp) / sum(support) AS accuracy,
  sum(precision * support) / sum(support) AS precision_weighted,
  sum(recall * support) / sum(support) AS recall_weighted,
  sum(f1 * support) / sum(support) AS f1_weighted,
  avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
  cast(sum(support) AS BIGINT) AS test_set_size FROM pc GROUP BY model)"""
_GRID = """ids AS (SELECT model, l, cast(row_number() OVER (PARTITION BY model ORDER BY l) - 1 AS INTEGER) AS id
  FROM (SELECT model, y_true AS l FROM counts UNION SELECT model, y_pred FROM counts) AS u),
cm AS (SELECT a.model, a.id AS true_id, a.l AS y_true, b.id AS pred_id, b.l AS y_pred, coalesce(c.n, 0) AS n
  FROM ids a JOIN ids b ON a.model = b.model
  LEFT JOIN counts c ON c.model = a.model AND c.y_true = a.l AND c.y_pred = b.l)"""


def _sql(body: str, *ctes: str) -> str:
    base = fx.with_ctes("SELECT 1", "preds")[len("WITH "):-len("\nSELECT 1")]
    return "WITH " + base + ",\n" + ",\n".join(ctes) + "\n" + body


_OV_COLS = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted",
            "precision_macro", "recall_macro", "f1_macro"]


def _ov_out(df, keys):
    return df.select(*keys, *[r(c).alias(c) for c in _OV_COLS], "test_set_size")


def _ov_sql(keys: str) -> str:
    return ", ".join([*([keys] if keys else []), *[f"{sr(c)} AS {c}" for c in _OV_COLS], "test_set_size"])


@register("confusion_matrix", _sql("SELECT * FROM cm", _COUNTS, _GRID))
def q_confusion_matrix(spark, sf_dir):
    return mt.confusion_matrix(fx.load(spark, sf_dir, "preds"), ["model"])


@register("confusion_matrix_norm", _sql(
    f"SELECT model, y_true, y_pred, n, {sr('CASE WHEN sum(n) OVER (PARTITION BY model, y_true) = 0 THEN 0.0 '
                                     'ELSE n / sum(n) OVER (PARTITION BY model, y_true) END')} AS share FROM cm",
    _COUNTS, _GRID))
def q_confusion_matrix_norm(spark, sf_dir):
    cm = mt.confusion_matrix(fx.load(spark, sf_dir, "preds"), ["model"])
    out = mt.confusion_matrix_norm(cm, ["model"])
    return out.select("model", "y_true", "y_pred", "n", r("share").alias("share"))


@register("metrics_overall", _sql(f"SELECT {_ov_sql('')} FROM ov", _COUNTS.replace("SELECT model,", "SELECT 'all' AS model,"),
                                  _STATS, _PC, _OV))
def q_metrics_overall(spark, sf_dir):
    """One row over the predictions of all models."""
    return _ov_out(mt.metrics(fx.load(spark, sf_dir, "preds"), []), [])


@register("metrics_by_model", _sql(f"SELECT {_ov_sql('model')} FROM ov", _COUNTS, _STATS, _PC, _OV))
def q_metrics_by_model(spark, sf_dir):
    return _ov_out(mt.metrics(fx.load(spark, sf_dir, "preds"), ["model"]), ["model"])


@register("metrics_per_class", _sql(
    f"SELECT model, class_id, class_name, {sr('precision')} AS precision, {sr('recall')} AS recall, "
    f"{sr('f1')} AS f1, support FROM pc", _COUNTS, _STATS, _PC))
def q_metrics_per_class(spark, sf_dir):
    pc = mt.per_class(fx.load(spark, sf_dir, "preds"), ["model"])
    return pc.select("model", "class_id", "class_name", r("precision").alias("precision"),
                     r("recall").alias("recall"), r("f1").alias("f1"), "support")


@register("classification_report", _sql(
    f"SELECT model, row_name, {sr('precision')} AS precision, {sr('recall')} AS recall, "
    f"{sr('f1_score')} AS f1_score, support FROM ("
    "SELECT model, class_name AS row_name, precision, recall, f1 AS f1_score, support FROM pc "
    "UNION ALL SELECT model, 'accuracy', NULL, NULL, accuracy, test_set_size FROM ov "
    "UNION ALL SELECT model, 'macro avg', precision_macro, recall_macro, f1_macro, test_set_size FROM ov "
    "UNION ALL SELECT model, 'weighted avg', precision_weighted, recall_weighted, f1_weighted, test_set_size FROM ov"
    ") AS rep", _COUNTS, _STATS, _PC, _OV))
def q_classification_report(spark, sf_dir):
    rep = mt.classification_report(fx.load(spark, sf_dir, "preds"), ["model"])
    return rep.select("model", "row_name", r("precision").alias("precision"), r("recall").alias("recall"),
                      r("f1_score").alias("f1_score"), "support")


@register("per_class_f1_ranked", _sql(
    f"SELECT model, class_name, {sr('f1')} AS f1, "
    "cast(row_number() OVER (PARTITION BY model ORDER BY f1, class_name) AS INTEGER) AS rank, "
    "CASE WHEN f1 >= 0.85 THEN 'good' WHEN f1 >= 0.5 THEN 'mid' ELSE 'bad' END AS band FROM pc",
    _COUNTS, _STATS, _PC))
def q_per_class_f1_ranked(spark, sf_dir):
    pc = mt.per_class(fx.load(spark, sf_dir, "preds"), ["model"])
    out = mt.per_class_f1_ranked(pc, ["model"])
    return out.select("model", "class_name", r("f1").alias("f1"), "rank", "band")


_CMP_SQL = ("SELECT class_name, "
            + ", ".join(f"{sr(f'coalesce(max(CASE WHEN model = {chr(39)}{m}{chr(39)} THEN f1 END), 0.0)')} AS f1_{m}"
                        for m in MODELS)
            + ", max(support) AS support FROM pc GROUP BY class_name")


@register("compare_models_join", _sql(_CMP_SQL, _COUNTS, _STATS, _PC))
def q_compare_models_join(spark, sf_dir):
    pc = mt.per_class(fx.load(spark, sf_dir, "preds"), ["model"])
    out = mt.compare_models(pc, MODELS)
    return out.select("class_name", *[r(f"f1_{m}").alias(f"f1_{m}") for m in MODELS], "support")


@register("per_file_accuracy", fx.with_ctes(
    f"SELECT model, file_id, {sr('avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n "
    "FROM preds GROUP BY model, file_id", "preds"))
def q_per_file_accuracy(spark, sf_dir):
    out = mt.per_file_accuracy(fx.load(spark, sf_dir, "preds"), ["model"])
    return out.select("model", "file_id", r("accuracy").alias("accuracy"), "n")


@register("sink_metrics_report", _sql(
    f"SELECT model AS model_name, class_name, {sr('f1')} AS f1_score, support FROM pc", _COUNTS, _STATS, _PC))
def q_sink_metrics_report(spark, sf_dir):
    """Write the nested evaluation records as JSON, read them back, flatten per class."""
    records = mt.evaluation_records(fx.load(spark, sf_dir, "preds"))
    path = scratch_path(spark, "metrics-report")
    records.write.mode("overwrite").json(path)
    back = spark.read.schema(records.schema).json(path)
    flat = back.select("model_name", F.inline("per_class"))
    return flat.select("model_name", "class_name", r("f1_score").alias("f1_score"), "support")
