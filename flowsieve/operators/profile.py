"""Column roles, one-pass column statistics and dataset summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import (DERIVED_FEATURES, FEATURE_ENG_VERSION, KNOWN_FEATURES,
                        KNOWN_LABEL_COLUMNS, MIN_KNOWN_FEATURES)
from ..functions.features import c, nonfinite

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class Roles:
    label: str | None
    features: list[str]          # in vector order (sorted)
    ignored: list[str]
    missing: list[str]           # known names absent from the table


def detect_columns(schema: T.StructType) -> Roles:
    """Label = first known label name present, else the last text column.

    Features = known names present (sorted) when at least 20 are present, else
    every numeric column except the label (sorted).  No feature is an error.
    """
    names = [f.name.strip() for f in schema.fields]
    types = {f.name.strip(): f.dataType for f in schema.fields}
    label = next((n for n in KNOWN_LABEL_COLUMNS if n in names), None)
    if label is None:
        text = [n for n in names if isinstance(types[n], T.StringType)]
        label = text[-1] if text else None
    known = [n for n in KNOWN_FEATURES if n in names]
    if len(known) >= MIN_KNOWN_FEATURES:
        features = sorted(known)
    else:
        features = sorted(n for n in names if isinstance(types[n], _NUMERIC) and n != label)
    if not features:
        raise ValueError("no numeric feature column found")
    ignored = [n for n in names if n not in features and n != label]
    missing = sorted(set(KNOWN_FEATURES) - set(names))
    return Roles(label, features, ignored, missing)


def column_profile(df: DataFrame) -> DataFrame:
    """Role of every column plus null and non-finite counts, all from one pass over the rows."""
    roles = detect_columns(df.schema)
    types = {f.name: f.dataType for f in df.schema.fields}
    present = [n for n in df.columns]
    aggs = []
    for i, n in enumerate(present):
        aggs.append(F.count_if(c(n).isNull()).alias(f"__null_{i}"))
        if isinstance(types[n], (T.FloatType, T.DoubleType)):
            aggs.append(F.count_if(nonfinite(c(n))).alias(f"__nf_{i}"))
        else:
            aggs.append(F.count_if(c(n).isNull()).alias(f"__nf_{i}"))
    one = df.agg(*aggs)
    entries = []
    for i, n in enumerate(present):
        if n == roles.label:
            role, pos = "label", None
        elif n in roles.features:
            role, pos = "feature", roles.features.index(n)
        else:
            role, pos = "ignored", None
        entries.append((n, role, pos, F.col(f"__null_{i}"), F.col(f"__nf_{i}")))
    for n in roles.missing:
        entries.append((n, "missing", None, F.lit(None).cast("long"), F.lit(None).cast("long")))
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(role).alias("role"),
                              F.lit(pos).cast("int").alias("position"),
                              nn.cast("long").alias("n_null"), nf.cast("long").alias("n_nonfinite"))
                     for n, role, pos, nn, nf in entries])
    return one.select(F.inline(rows))


def feature_label_split(df: DataFrame) -> DataFrame:
    """Feature columns in vector order, plus the label when there is one."""
    roles = detect_columns(df.schema)
    cols = [c(n) for n in roles.features]
    if roles.label:
        cols.append(c(roles.label))
    return df.select(*cols)


def dataset_summary(df: DataFrame, label: str = "label", file_col: str = "file_id",
                    group: bool = True) -> DataFrame:
    """One row: files, rows, columns, raw/derived/total features, classes, version."""
    from .labels import grouped
    roles = detect_columns(df.schema)
    lab = grouped(F.col(label)) if group else F.col(label)
    n_feat = len(roles.features)
    return df.agg(
        F.countDistinct(F.col(file_col)).alias("files"),
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(lab).alias("classes"),
    ).select(
        "files", "rows",
        F.lit(n_feat + (1 if roles.label else 0)).alias("columns"),
        F.lit(n_feat).alias("raw_features"),
        F.lit(len(DERIVED_FEATURES)).alias("derived_features"),
        F.lit(n_feat + len(DERIVED_FEATURES)).alias("total_features"),
        "classes",
        F.lit(FEATURE_ENG_VERSION).alias("feature_eng_version"),
    )
