"""Label work: grouping, class lists, label indexes, distributions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import CLASS_GROUPING


def grouping_map() -> Column:
    """The 34 -> 16 grouping as a map literal (evaluated in codegen, no join)."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CLASS_GROUPING.items()))


def grouped(label: Column) -> Column:
    """Grouped name; labels outside the map pass through unchanged (case-sensitive)."""
    return F.coalesce(F.try_element_at(grouping_map(), label), label)


def group_labels(df: DataFrame, label: str = "label", out: str = "label_group") -> DataFrame:
    return df.withColumn(out, grouped(F.col(label)))


def known_class_semi(df: DataFrame, classes: list[str], label: str = "label_group") -> DataFrame:
    """Rows whose label is one of ``classes``; null labels drop.

    The class list is bounded by the label vocabulary, so ``isin`` keeps it a
    filter in the scan stage (equivalent to a broadcast left-semi join).
    """
    return df.where(F.col(label).isin(*classes))


def class_scan(df: DataFrame, label: str = "label", group: bool = True) -> DataFrame:
    """Distinct non-null labels (optionally grouped); only the label column is read."""
    col = F.col(label)
    out = df.select((grouped(col) if group else col).alias("class_name")).where(F.col("class_name").isNotNull())
    return out.distinct()


def label_index(classes: DataFrame, name: str = "class_name") -> DataFrame:
    """Sorted (binary order) class names -> 0..K-1.

    The input is one row per class (bounded by the vocabulary), so one
    un-partitioned window over it is cheap.
    """
    w = Window.orderBy(F.col(name))
    return classes.select(name, (F.row_number().over(w) - 1).cast("int").alias("class_index"))


def encode(df: DataFrame, index: DataFrame, label: str, out: str = "class_index") -> DataFrame:
    """Join the label index (one row per class; AQE broadcasts it by measured size)."""
    idx = index.select(F.col("class_name").alias("__cls"), F.col("class_index").alias(out))
    return df.join(idx, df[label] == idx["__cls"], "left").drop("__cls")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str = "label", top: int | None = None) -> DataFrame:
    """Count, percent and rank of every class; with ``top``, of the largest ones and the number left over.

    The window runs over one row per class, not over the data.
    """
    counts = class_counts(df, label)
    w_all = Window.partitionBy()
    w_rank = Window.orderBy(F.col("n").desc(), F.col("class_name"))
    ranked = counts.select(
        "class_name", "n",
        (F.lit(100.0) * F.col("n") / F.sum("n").over(w_all)).alias("pct"),
        F.row_number().over(w_rank).alias("rank"),
        (F.greatest(F.count(F.lit(1)).over(w_all) - F.lit(top), F.lit(0)) if top is not None else F.lit(0))
        .cast("long").alias("n_other_classes"),
    )
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def balance_check(df: DataFrame, label: str = "label") -> DataFrame:
    """Number of classes and whether there are at least two."""
    return (df.agg(F.countDistinct(F.col(label)).alias("n_classes"))
            .withColumn("balanced", F.col("n_classes") >= 2))


def class_share_top(df: DataFrame, label: str = "label", top: int = 5, others: str = "others") -> DataFrame:
    """The ``top`` largest classes plus one bucket for the rest, with share."""
    counts = class_counts(df, label)
    w_rank = Window.orderBy(F.col("n").desc(), F.col("class_name"))
    ranked = counts.withColumn("__rank", F.row_number().over(w_rank))
    bucketed = ranked.withColumn(
        "bucket", F.when(F.col("__rank") <= top, F.col("class_name")).otherwise(F.lit(others)))
    agg = bucketed.groupBy("bucket").agg(F.sum("n").alias("n"))
    return agg.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
