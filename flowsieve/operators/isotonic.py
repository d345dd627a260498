"""Isotonic calibration of all classes at once, from pooled blocks that can be merged.

Pool-adjacent-violators joins neighbours (in the order of the predicted value)
until their mean targets rise.  Neighbours that a stretch of the order pools on
its own stay pooled in the whole, so the method works in two steps: every range
partition pools its own rows into blocks, then the blocks of a class, in order,
are pooled once more.  Blocks of targets 0 and 1 have strictly rising means with
their rows as denominators, so ``n`` rows leave at most about ``n ** (2/3)`` of
them, in practice a few dozen.

The fitted function is flat within a block, linear between blocks and constant
beyond the ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "class_index int, low double, high double, total double, n double"


def pool(low: np.ndarray, high: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Blocks (rows of low, high, total, n) with rising means from blocks in order."""
    out: list[list[float]] = []
    for a, b, t, w in zip(low.tolist(), high.tolist(), total.tolist(), n.tolist()):
        # as long as the block before does not lie lower, both are one
        while out and out[-1][2] * w >= t * out[-1][3]:
            a, _, t0, w0 = out.pop()
            t, w = t + t0, w + w0
        out.append([a, b, t, w])
    return np.array(out, dtype=float).reshape(-1, 4)


def fit(rows: DataFrame, proba: str, target: str) -> DataFrame:
    """Blocks per class: ``class_index, low, high, total, n``; ``target`` is the index of a row's class.

    Rows without probabilities or target are left out.
    """
    one = (rows.where(F.col(proba).isNotNull() & F.col(target).isNotNull())
           .select(F.col(target).alias("__y"), F.posexplode(proba).alias("class_index", "p")))
    points = (one.where(F.col("p").isNotNull() & ~F.isnan("p"))
              .groupBy(F.col("class_index").cast("int").alias("class_index"), "p")
              .agg(F.sum(F.when(F.col("__y") == F.col("class_index"), 1.0).otherwise(0.0)).alias("total"),
                   F.count(F.lit(1)).cast("double").alias("n")))
    ranged = points.repartitionByRange("class_index", "p").sortWithinPartitions("class_index", "p")

    def local(batches):
        held = None  # the class that a batch leaves open
        for batch in batches:
            c, p, t, n = (batch.column(x).to_numpy() for x in ("class_index", "p", "total", "n"))
            for k in np.unique(c):
                own = c == k
                blocks = np.stack([p[own], p[own], t[own], n[own]], axis=1)
                if held is not None and held[0] == k:
                    blocks = np.concatenate((held[1], blocks))
                elif held is not None:
                    yield _batch(*held)
                held = (int(k), pool(*blocks.T))
        if held is not None:
            yield _batch(*held)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        blocks = pool(*(pdf[c].to_numpy() for c in ("low", "high", "total", "n")))
        out = pd.DataFrame(blocks, columns=["low", "high", "total", "n"])
        out.insert(0, "class_index", np.full(len(out), pdf["class_index"].iloc[0], np.int32))
        return out

    return ranged.mapInArrow(local, BLOCK).groupBy("class_index").applyInPandas(whole, BLOCK)


def _batch(k: int, blocks: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), k, np.int32)), *(pa.array(blocks[:, i]) for i in range(4))],
                                      ["class_index", "low", "high", "total", "n"])


def functions(blocks) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per class the nodes of its function, from collected blocks."""
    by_class: dict[int, list] = {}
    for r in blocks:
        by_class.setdefault(r["class_index"], []).append((r["low"], r["high"], r["total"] / r["n"]))
    out = {}
    for k, own in by_class.items():
        own.sort()
        out[k] = (np.array([x for lo, hi, _ in own for x in (lo, hi)]), np.array([v for *_, v in own for _ in (0, 1)]))
    return out


def calibrate(rows: DataFrame, proba: str, blocks, name: str = "calibrated") -> DataFrame:
    """Calibrated, renormalised probabilities of every row, in one Arrow pass; all zero becomes uniform.

    ``blocks`` are the collected rows of ``fit``; a class without blocks keeps its probability.
    """
    known = functions(blocks)

    @F.pandas_udf("array<double>")
    def apply(column: pd.Series) -> pd.Series:
        full = column[column.notna()]
        out = pd.Series([None] * len(column), index=column.index, dtype=object)
        if len(full):
            x = np.stack(full.to_numpy()).astype(float)
            for k, (at, value) in known.items():
                x[:, k] = np.interp(x[:, k], at, value)
            s = x.sum(axis=1, keepdims=True)
            x = np.where(s == 0, 1.0 / x.shape[1], x / np.where(s == 0, 1.0, s))
            out[full.index] = list(x)
        return out

    return rows.withColumn(name, apply(F.col(proba)))
