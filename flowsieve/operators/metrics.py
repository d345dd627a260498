"""Classification metrics from a predictions table ``(keys..., y, yhat)``.

Everything starts from the confusion counts ``groupBy(keys, y, yhat).count()``
(partial aggregation, one row per cell), so the data is read once and the rest
works on at most ``K^2`` rows per model.  Labels are the union of true and
predicted labels per model; a label that is only predicted has support 0 and
still counts in macro averages.  Division by zero gives 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contract import F1_GOOD, F1_MID


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion_counts(preds: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    return preds.groupBy(*keys, F.col(y).alias("y_true"), F.col(yhat).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def label_union(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted union of true and predicted labels per key (bounded by the class count)."""
    return counts.groupBy(*keys).agg(
        F.array_sort(F.array_union(F.collect_set("y_true"), F.collect_set("y_pred"))).alias("labels"))


def confusion_matrix(preds: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Counts per (true, predicted) over the label union, zero cells included."""
    counts = confusion_counts(preds, keys, y, yhat)
    grid = (label_union(counts, keys)
            .select(*keys, F.posexplode("labels").alias("true_id", "y_true"), "labels")
            .select(*keys, "true_id", "y_true", F.posexplode("labels").alias("pred_id", "y_pred")))
    cells = grid.join(counts, [*keys, "y_true", "y_pred"], "left")
    return cells.select(*keys, "true_id", "y_true", "pred_id", "y_pred",
                        F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def confusion_matrix_norm(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Row-normalised matrix; a row with no true rows stays 0."""
    w = Window.partitionBy(*keys, "y_true")
    return matrix.withColumn("share", _safe_div(F.col("n"), F.sum("n").over(w)))


def class_stats(counts: DataFrame, keys: list[str]) -> DataFrame:
    """tp, support and predicted count per (keys, class) in one aggregation."""
    sides = F.array(
        F.struct(F.col("y_true").alias("class_name"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("y_pred").alias("class_name"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )
    return (counts.select(*keys, F.inline(sides))
            .groupBy(*keys, "class_name")
            .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                 F.sum("predicted").alias("predicted")))


def per_class(preds: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Precision, recall, F1 and support per class of the label union."""
    st = class_stats(confusion_counts(preds, keys, y, yhat), keys)
    w = Window.partitionBy(*keys).orderBy("class_name")
    return st.select(
        *keys,
        (F.row_number().over(w) - 1).cast("int").alias("class_id"),
        "class_name",
        _safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
        _safe_div(F.col("tp"), F.col("support")).alias("recall"),
        _safe_div(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "tp", "predicted",
    )


def overall(per_cls: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy and weighted / macro precision, recall, F1 per key."""
    n = F.sum("support")
    return per_cls.groupBy(*keys).agg(
        _safe_div(F.sum("tp"), n).alias("accuracy"),
        _safe_div(F.sum(F.col("precision") * F.col("support")), n).alias("precision_weighted"),
        _safe_div(F.sum(F.col("recall") * F.col("support")), n).alias("recall_weighted"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), n).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        n.alias("test_set_size"),
    )


def metrics(preds: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    return overall(per_class(preds, keys, y, yhat), keys)


def classification_report(preds: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Per-class rows, then 'accuracy', 'macro avg' and 'weighted avg' rows."""
    pc = per_class(preds, keys, y, yhat)
    ov = overall(pc, keys)
    rows = pc.select(*keys, F.col("class_name").alias("row_name"), "precision", "recall",
                     F.col("f1").alias("f1_score"), "support")
    acc = ov.select(*keys, F.lit("accuracy").alias("row_name"), F.lit(None).cast("double").alias("precision"),
                    F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1_score"),
                    F.col("test_set_size").alias("support"))
    macro = ov.select(*keys, F.lit("macro avg").alias("row_name"), F.col("precision_macro").alias("precision"),
                      F.col("recall_macro").alias("recall"), F.col("f1_macro").alias("f1_score"),
                      F.col("test_set_size").alias("support"))
    weighted = ov.select(*keys, F.lit("weighted avg").alias("row_name"),
                         F.col("precision_weighted").alias("precision"),
                         F.col("recall_weighted").alias("recall"), F.col("f1_weighted").alias("f1_score"),
                         F.col("test_set_size").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def f1_band(f1) -> F.Column:
    return F.when(f1 >= F1_GOOD, "good").when(f1 >= F1_MID, "mid").otherwise("bad")


def per_class_f1_ranked(per_cls: DataFrame, keys: list[str]) -> DataFrame:
    """Classes by ascending F1 (ties by name) with a quality band."""
    w = Window.partitionBy(*keys).orderBy("f1", "class_name")
    return per_cls.select(*keys, "class_name", "f1", F.row_number().over(w).alias("rank"),
                          f1_band(F.col("f1")).alias("band"))


def compare_models(per_cls: DataFrame, models: list[str], model: str = "model") -> DataFrame:
    """Class x model F1 table aligned by class name (not list position), with support."""
    wide = per_cls.groupBy("class_name").pivot(model, models).agg(F.first("f1"))
    support = per_cls.groupBy("class_name").agg(F.max("support").alias("support"))
    out = wide.join(support, "class_name", "full")
    return out.select("class_name", *[F.coalesce(F.col(m), F.lit(0.0)).alias(f"f1_{m}") for m in models],
                      "support")


def per_file_accuracy(preds: DataFrame, keys: list[str], file_col: str = "file_id",
                      y: str = "y", yhat: str = "yhat") -> DataFrame:
    return preds.groupBy(*keys, file_col).agg(
        F.avg(F.when(F.col(y) == F.col(yhat), 1.0).otherwise(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def evaluation_records(preds: DataFrame, model: str = "model", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One nested evaluation record per model: scalars, per-class structs, matrix and labels."""
    keys = [model]
    pc = per_class(preds, keys, y, yhat)
    ov = overall(pc, keys)
    per = pc.groupBy(model).agg(F.array_sort(F.collect_list(F.struct(
        "class_id", "class_name", "precision", "recall", F.col("f1").alias("f1_score"), "support")))
        .alias("per_class"))
    cm = confusion_matrix(preds, keys, y, yhat)
    rows = cm.groupBy(model, "true_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pred_id", "n"))), lambda s: s["n"]).alias("row"))
    matrix = rows.groupBy(model).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("true_id", "row"))), lambda s: s["row"])
        .alias("confusion_matrix"))
    labels = label_union(confusion_counts(preds, keys, y, yhat), keys).withColumnRenamed(
        "labels", "confusion_matrix_labels")
    return (ov.join(per, model).join(matrix, model).join(labels, model)
            .withColumnRenamed(model, "model_name"))
