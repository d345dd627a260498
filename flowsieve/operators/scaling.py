"""Standard scaling: mean and population standard deviation, constant columns scale 1."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import SCALER_FILES, SCALER_ROWS_PER_FILE
from ..functions.features import add_derived_features, c, clean_nonfinite
from . import sampling


def vector_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: ``feature, position, n, mean, var`` (population variance).

    The columns are assembled into one vector and summarised by Spark ML's
    ``Summarizer`` in a single compiled pass (one aggregation buffer per vector
    instead of two per column).  Columns must be non-null (clean them first).
    """
    cols = [c(n).cast("double").alias(f"__c{i}") for i, n in enumerate(columns)]
    vec = df.select(*cols).withColumn("__v", array_to_vector(F.array(*[f"__c{i}" for i in range(len(columns))])))
    # one aggregation: plain sums give the means (the SQL avg definition), the
    # vector summary gives the variances
    summary = vec.agg(F.count(F.lit(1)).alias("n"),
                      F.array(*[F.sum(f"__c{i}") for i in range(len(columns))]).alias("__sums"),
                      Summarizer.metrics("variance").summary(F.col("__v")).alias("s"))
    names = F.array(*[F.lit(n) for n in columns])
    long = summary.select("n", F.posexplode("__sums").alias("position", "__sum"),
                          vector_to_array("s.variance").alias("__vars"))
    n = F.col("n")
    sample_var = F.element_at("__vars", F.col("position") + 1)
    return long.select(F.element_at(names, F.col("position") + 1).alias("feature"),
                       F.col("position").cast("int").alias("position"), "n", (F.col("__sum") / n).alias("mean"),
                       F.when(n > 1, sample_var * (n - 1) / n).otherwise(F.lit(0.0)).alias("var"))


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per feature: ``feature, position, n, mean, var, scale``.

    Mean and population variance come from one pass; a zero variance scales
    by 1, leaving the column centred.
    """
    out = vector_summary(df, columns)
    std = F.sqrt(F.col("var"))
    return out.select("feature", "position", "n", "mean", "var",
                      F.when(std == 0, F.lit(1.0)).otherwise(std).alias("scale"))


def fit_scaler_sampled(df: DataFrame, file_col: str, order_col: str, raw: list[str],
                       n_files: int = SCALER_FILES, rows_per_file: int = SCALER_ROWS_PER_FILE,
                       seed: int = 42, derive: bool = True) -> DataFrame:
    """Scaler fitted on the first ``rows_per_file`` rows of ``n_files`` seeded files,
    after cleaning and (optionally) adding the derived features."""
    picked = sampling.pick_files(df, file_col, n_files, seed).select(file_col)
    chosen = df.join(picked, file_col, "left_semi")
    head = sampling.head_per_file(chosen, file_col, order_col, rows_per_file)
    feats = clean_nonfinite(head.select(*[c(n) for n in raw]), raw)
    cols = list(raw)
    if derive:
        feats = add_derived_features(feats)
        cols = feats.columns
    return fit_scaler(feats, cols)


def scaler_params(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """Collect the fitted parameters: one row per feature, bounded by the feature count."""
    return {r["feature"]: (r["mean"], r["scale"]) for r in stats.select("feature", "mean", "scale").collect()}


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """``(x - mean) / scale`` for every fitted column, with the parameters as literals."""
    return df.select(*[((c(n) - F.lit(params[n][0])) / F.lit(params[n][1])).alias(n) if n in params else c(n)
                       for n in df.columns])
