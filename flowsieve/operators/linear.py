"""Linear one-vs-rest models: scoring, probabilities, voting, argmax.

A model is a small coefficient table ``(model, class_index, feature_index,
weight)`` plus a bias per class (``feature_index = -1``); it is K x F numbers,
bounded by the model, not by the data.  Decision values of all models come
from one Arrow-batched numpy matrix product per batch (``decision_udf``);
probabilities, the vote and the argmax are row-local Spark expressions.  No
shuffle anywhere in scoring.  ``decision_values`` is the same computation as a
pure expression, for callers that want no Python at all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class LinearModel:
    name: str
    loss: str                       # modified_huber | log_loss | hinge (decision only)
    weights: list[list[float]]      # K x F
    bias: list[float]               # K
    vote_weight: float = 1.0
    meta: dict = field(default_factory=dict)   # ``steps``: updates so far, which set the learning rate

    @property
    def n_classes(self) -> int:
        return len(self.bias)


def coefficient_rows(models: list[LinearModel]) -> list[tuple]:
    rows = []
    for m in models:
        for k, (w, b) in enumerate(zip(m.weights, m.bias)):
            head = (m.name, m.loss, float(m.vote_weight), float(m.meta.get("steps", 0.0)), k)
            rows.append((*head, -1, float(b)))
            rows += [(*head, j, float(x)) for j, x in enumerate(w)]
    return rows


COEF_SCHEMA = ("model string, loss string, vote_weight double, steps double, class_index int, feature_index int, "
               "weight double")


def models_from_rows(rows) -> list[LinearModel]:
    """Rebuild models from collected coefficient rows (bounded: K x F per model); a lost coefficient is an error."""
    by_model: dict[str, dict] = {}
    for r in rows:
        m = by_model.setdefault(r["model"], {"loss": r["loss"], "vw": r["vote_weight"], "steps": r["steps"], "w": {}, "b": {}})
        if r["feature_index"] < 0:
            m["b"][r["class_index"]] = r["weight"]
        else:
            m["w"].setdefault(r["class_index"], {})[r["feature_index"]] = r["weight"]
    out = []
    for name, m in by_model.items():
        k = 1 + max([*m["b"], *m["w"]])
        f = 1 + max((max(v) for v in m["w"].values()), default=-1)
        lost = [(i, j) for i in range(k) for j in range(-1, f) if j not in (m["w"].get(i, {}) if j >= 0 else {-1} if i in m["b"] else {})]
        if lost:
            raise ValueError(f"{name}: {len(lost)} coefficients are missing, the first is {lost[0]}")
        w = [[m["w"][i][j] for j in range(f)] for i in range(k)]
        out.append(LinearModel(name, m["loss"], w, [m["b"][i] for i in range(k)], m["vw"], {"steps": m["steps"]}))
    return out


def decision_values(vec: Column, model: LinearModel) -> Column:
    """``array<double>`` of K decision values ``w_k . x + b_k``.

    Each dot product is one ``aggregate(zip_with(x, w))`` over the vector and a
    literal weight array: a compact expression (cheap to plan and compile)
    evaluated inside the executor JVM, element order fixed (left to right).
    """
    x = F.transform(vec, lambda v: v.cast("double"))
    scores = []
    for w, b in zip(model.weights, model.bias):
        lit_w = F.array(*[F.lit(float(wj)) for wj in w])
        dot = F.aggregate(F.zip_with(x, lit_w, lambda a, c: a * c), F.lit(float(b)), lambda acc, t: acc + t)
        scores.append(dot)
    return F.array(*scores)


def _normalise(p: Column, k: int) -> Column:
    s = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.when(s == 0, F.array_repeat(F.lit(1.0 / k), k)).otherwise(F.transform(p, lambda x: x / s))


def probabilities(scores: Column, loss: str, k: int) -> Column:
    """One-vs-rest probabilities from decision values.

    modified_huber: ``(clip(d, -1, 1) + 1) / 2``; log_loss: ``sigmoid(d)``;
    both normalised per row, an all-zero row becomes uniform.
    """
    if loss == "modified_huber":
        p = F.transform(scores, lambda d: (F.least(F.greatest(d, F.lit(-1.0)), F.lit(1.0)) + 1.0) / 2.0)
    elif loss == "log_loss":
        p = F.transform(scores, lambda d: F.lit(1.0) / (F.lit(1.0) + F.exp(-d)))
    else:
        return softmax(scores)
    return _normalise(p, k)


def softmax(scores: Column) -> Column:
    """Numerically stable softmax; a single score s is treated as (-s, s)."""
    two = F.when(F.size(scores) == 1, F.array(-scores.getItem(0), scores.getItem(0))).otherwise(scores)
    mx = F.array_max(two)
    e = F.transform(two, lambda d: F.exp(d - mx))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def soft_vote(probs: list[Column], weights: list[float], k: int) -> Column:
    """Weighted mean of the models' probability arrays; no model -> uniform."""
    if not probs:
        return F.array_repeat(F.lit(1.0 / k), k)
    total = float(sum(weights))

    def add(weight: float):
        return lambda a, b: a + b * F.lit(weight)

    acc = F.transform(probs[0], lambda x: x * F.lit(weights[0]))
    for p, w in zip(probs[1:], weights[1:]):
        acc = F.zip_with(acc, p, add(w))
    return F.transform(acc, lambda x: x / F.lit(total))


def argmax(p: Column) -> Column:
    """Index of the largest value; ties go to the lowest index."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def decision_udf(models: list[LinearModel]):
    """Arrow-batched decision values of several models: one ``X @ W.T + b`` per batch.

    Dense matrix products are where numpy beats per-element expressions by
    orders of magnitude; the coefficients travel inside the function (K x F
    numbers per model).  Returns a struct with one ``array<double>`` per model.
    """
    mats = [(m.name, np.asarray(m.weights, dtype=np.float64).T, np.asarray(m.bias, dtype=np.float64))
            for m in models]
    schema = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n, _, _ in mats])

    @F.arrow_udf(schema)
    def scores(x: pa.Array) -> pa.Array:
        xs, valid = _matrix(x)
        return pa.StructArray.from_arrays([_lists(xs @ w + b if len(xs) else np.zeros((0, len(b))), valid) for _, w, b in mats],
                                          names=[n for n, _, _ in mats])

    return scores


def _matrix(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are not null as one matrix over the column's own buffer, and which rows those are."""
    valid = x.is_valid().to_numpy(zero_copy_only=False)
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    n = int(valid.sum())
    return flat.reshape(n, -1) if n else np.zeros((0, 0)), valid


def _lists(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A list per row of ``rows``; null where ``valid`` is false."""
    size = np.zeros(len(valid) + 1, np.int32)
    size[1:] = np.cumsum(valid) * rows.shape[1]
    mask = None if valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(size), pa.array(rows.ravel()), mask=mask)


def _values(values: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A value per row; null where ``valid`` is false."""
    if valid.all():
        return pa.array(values)
    full = np.zeros(len(valid), values.dtype)
    full[valid] = values
    return pa.array(full, mask=~valid)


def score_frame(df: DataFrame, vec: str, models: list[LinearModel], keep: list[str]) -> DataFrame:
    """One column of decision values per model (``scores_<model>``), from one vectorised pass."""
    scored = df.select(*keep, decision_udf(models)(F.col(vec)).alias("__s"))
    return scored.select(*keep, *[F.col("__s").getField(m.name).alias(f"scores_{m.name}") for m in models])


def _np_probabilities(d: np.ndarray, loss: str) -> np.ndarray:
    """numpy twin of ``probabilities`` (rows = samples, columns = classes)."""
    k = d.shape[1]
    if loss == "modified_huber":
        p = (np.clip(d, -1.0, 1.0) + 1.0) / 2.0
    elif loss == "log_loss":
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-d))
    else:
        e = np.exp(d - d.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    s = p.sum(axis=1, keepdims=True)
    return np.where(s == 0, 1.0 / k, p / np.where(s == 0, 1.0, s))


def vote_udf(groups: dict[str, list[LinearModel]], with_proba: bool = False):
    """Arrow-batched ensemble vote: per group ``<g>_idx`` (argmax, ties -> lowest index),
    ``<g>_conf`` (winning probability) and optionally ``<g>_proba``.

    Decision values, probabilities, weighted mean and argmax are one numpy pass
    per batch -- the same arithmetic as the Spark-expression operators above.
    """
    unique = {}
    for models in groups.values():
        for m in models:
            unique.setdefault(m.name, m)
    mats = {n: (np.asarray(m.weights, dtype=np.float64).T, np.asarray(m.bias, dtype=np.float64), m.loss)
            for n, m in unique.items()}
    plan = [(g, [(m.name, float(m.vote_weight)) for m in models]) for g, models in groups.items()]
    fields = []
    for g, _ in plan:
        fields += [T.StructField(f"{g}_idx", T.IntegerType()), T.StructField(f"{g}_conf", T.DoubleType())]
        if with_proba:
            fields.append(T.StructField(f"{g}_proba", T.ArrayType(T.DoubleType())))
    schema = T.StructType(fields)

    width = {g: len(models[0].bias) for g, models in groups.items()}

    @F.arrow_udf(schema)
    def vote(x: pa.Array) -> pa.Array:
        xs, valid = _matrix(x)
        probs = {n: _np_probabilities(xs @ w + b, loss) for n, (w, b, loss) in mats.items()} if len(xs) else {}
        out = []
        for g, members in plan:
            total = sum(wt for _, wt in members)
            p = sum(probs[n] * wt for n, wt in members) / total if probs else np.zeros((0, width[g]))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
            out += [_values(best.astype(np.int32), valid), _values(p[np.arange(len(p)), best], valid)]
            if with_proba:
                out.append(_lists(p, valid))
        return pa.StructArray.from_arrays(out, names=[f.name for f in fields])

    return vote


def predict(df: DataFrame, vec: str, models: list[LinearModel], class_names: list[str],
            keep: list[str]) -> DataFrame:
    """Ensemble vote: label, confidence (the winning probability) and the probability array."""
    names = F.array(*[F.lit(c) for c in class_names])
    out = df.select(*keep, vote_udf({"e": models}, with_proba=True)(F.col(vec)).alias("__v"))
    idx = F.col("__v.e_idx")
    return out.select(*keep, F.col("__v.e_proba").alias("proba"), idx.alias("class_index"),
                      F.element_at(names, idx + 1).alias("label"), F.col("__v.e_conf").alias("confidence"))


def predict_many(df: DataFrame, vec: str, groups: dict[str, list[LinearModel]], class_names: list[str],
                 keep: list[str]) -> DataFrame:
    """Predictions of several models / ensembles in ONE pass over the rows.

    Returns ``keep..., model, class_index, label, confidence`` with one row per
    input row and group (decision values of a model are computed once per batch).
    """
    names = F.array(*[F.lit(c) for c in class_names])
    keys = {g: f"g{i}" for i, g in enumerate(groups)}
    voted = df.select(*keep, vote_udf({keys[g]: m for g, m in groups.items()})(F.col(vec)).alias("__v"))
    outs = [F.struct(F.lit(g).alias("model"), F.col(f"__v.{keys[g]}_idx").alias("class_index"),
                     F.col(f"__v.{keys[g]}_conf").alias("confidence")) for g in groups]
    long = voted.select(*keep, F.inline(F.array(*outs)))
    return long.select(*keep, "model", "class_index",
                       F.element_at(names, F.col("class_index") + 1).alias("label"), "confidence")


def class_means(df: DataFrame, vec: str, label: str, dim: int) -> dict[int, list[float]]:
    """Per-class mean vector (one aggregation; K x dim numbers come back)."""
    aggs = [F.avg(F.col(vec).getItem(j).cast("double")).alias(f"m{j}") for j in range(dim)]
    rows = df.groupBy(label).agg(*aggs).collect()
    return {r[label]: [r[f"m{j}"] for j in range(dim)] for r in rows}
