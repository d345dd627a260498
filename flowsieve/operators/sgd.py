"""Distributed one-vs-rest SGD (modified_huber / log_loss; l2, l1, elasticnet).

Parameter averaging per round: every partition runs mini-batch SGD over its
own rows starting from the current (broadcast) coefficients, emits its
coefficients weighted by its row count, and the driver averages them (a
small aggregation: configs x K x (F+1) rows).  Every configuration of a grid
is trained in the same pass over the data.  The data is hash-partitioned and
sorted by a seeded hash, so a run is deterministic; ``fit`` packs it once into
compressed blocks of one Arrow batch each, which all rounds read from disk, a few
at a time.

Learning rate: the ``optimal`` schedule ``1 / (alpha (t + t0))`` with
``t0 = 1 / (eta0 alpha)``, ``eta0 = typw / max(1, |loss'(-typw)|)``,
``typw = alpha^(-1/4)``; ``t`` is kept in the model so updates continue it.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import ELASTICNET_L1_RATIO
from .linear import LinearModel, _matrix

BATCH = 256
#: Bytes of packed blocks that a round hands to Python at once; the executor and its worker both hold them.
ROUND_BYTES = 8 << 20


@dataclass
class SgdConfig:
    name: str
    loss: str = "modified_huber"
    penalty: str = "l2"
    alpha: float = 1e-4
    vote_weight: float = 1.0

    @property
    def l1_ratio(self) -> float:
        return {"l2": 0.0, "l1": 1.0, "elasticnet": ELASTICNET_L1_RATIO}[self.penalty]


@dataclass
class SgdState:
    config: SgdConfig
    w: np.ndarray                   # K x F
    b: np.ndarray                   # K
    t: float = 1.0
    meta: dict = field(default_factory=dict)

    def to_model(self) -> LinearModel:
        return LinearModel(self.config.name, self.config.loss, self.w.tolist(), self.b.tolist(),
                           self.config.vote_weight, {"steps": float(self.t)})


def _dloss(loss: str, p: np.ndarray) -> np.ndarray:
    """d loss / d p for margin p = y * d."""
    if loss == "modified_huber":
        return np.where(p >= 1.0, 0.0, np.where(p >= -1.0, -2.0 * (1.0 - p), -4.0))
    return -1.0 / (1.0 + np.exp(np.clip(p, -50.0, 50.0)))


def _t0(cfg: SgdConfig) -> float:
    typw = cfg.alpha ** -0.25
    eta0 = typw / max(1.0, abs(float(_dloss(cfg.loss, np.array([-typw]))[0])))
    return 1.0 / (eta0 * cfg.alpha)


def local_pass(state: SgdState, x: np.ndarray, y: np.ndarray, sw: np.ndarray) -> SgdState:
    """One pass of mini-batch SGD over local rows (vectorised over classes)."""
    cfg = state.config
    w, b, t = state.w.copy(), state.b.copy(), state.t
    k = w.shape[0]
    t0 = _t0(cfg)
    classes = np.arange(k)
    for s in range(0, len(y), BATCH):
        xb, yb, wb = x[s:s + BATCH], y[s:s + BATCH], sw[s:s + BATCH]
        ypm = np.where(yb[:, None] == classes[None, :], 1.0, -1.0)
        d = xb @ w.T + b
        g = _dloss(cfg.loss, ypm * d) * ypm * wb[:, None]            # B x K
        eta = 1.0 / (cfg.alpha * (t + t0))
        l2 = cfg.alpha * (1.0 - cfg.l1_ratio)
        w *= max(0.0, 1.0 - eta * l2)
        w -= eta * (g.T @ xb) / len(yb)
        b -= eta * g.mean(axis=0)
        if cfg.l1_ratio > 0:
            shrink = eta * cfg.alpha * cfg.l1_ratio
            w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0.0)
        t += 1.0
    return SgdState(cfg, w, b, t)


_OUT_SCHEMA = "config string, class_index int, feature_index int, wsum double, n long, steps double"
_OUT_ARROW = pa.schema([("config", pa.string()), ("class_index", pa.int32()), ("feature_index", pa.int32()),
                        ("wsum", pa.float64()), ("n", pa.int64()), ("steps", pa.float64())])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, class numbers and weights of an Arrow batch."""
    x, _ = _matrix(batch.column("features"))
    y = batch.column("label_idx").to_numpy(zero_copy_only=False).astype(np.int64)
    return x, y, batch.column("weight").to_numpy(zero_copy_only=False).astype(np.float64)


def pack(data: DataFrame) -> DataFrame:
    """``rows, block``: every Arrow batch of ``features, label_idx, weight`` as one compressed block, in its place."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y, sw = _arrays(batch)
                block = pa.compress(np.vstack((x.T, y, sw)).tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), pa.array([block], pa.binary())], ["rows", "block"])
    return data.select("features", "label_idx", "weight").mapInArrow(run, "rows int, block binary")


def _unpack(rows: int, block: bytes, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = pa.decompress(block, decompressed_size=8 * rows * (features + 2), codec="zstd", asbytes=True)
    m = np.frombuffer(flat).reshape(features + 2, rows)
    return np.ascontiguousarray(m[:-2].T), m[-2].astype(np.int64), m[-1]


def _round_fn(states: list[SgdState]):
    def run(batches):
        # blocks arrive in partition order; the model state is carried from block
        # to block, so a task works on one block at a time, never its partition.
        current = [SgdState(st.config, st.w.copy(), st.b.copy(), st.t) for st in states]
        n = 0
        for rows, block in ((r, b) for batch in batches for r, b in zip(batch.column("rows").to_pylist(), batch.column("block"))):
            x, y, sw = _unpack(rows, block.as_buffer(), states[0].w.shape[1])
            current = [local_pass(st, x, y, sw) for st in current]
            n += len(y)
        if n == 0:
            return
        rows = []
        for old, new in zip(states, current):
            k, f = new.w.shape
            steps = new.t - old.t
            for ci in range(k):
                rows.append((old.config.name, ci, -1, float(new.b[ci]) * n, n, steps))
                rows.extend((old.config.name, ci, j, float(new.w[ci, j]) * n, n, steps) for j in range(f))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["config", "class_index", "feature_index", "wsum", "n", "steps"]),
                                         schema=_OUT_ARROW, preserve_index=False)
    return run


def prepare(df: DataFrame, features: str, label_idx: str, weight: str | None, key, seed: int,
            num_partitions: int) -> DataFrame:
    """Hash-partition and seed-sort the training rows (deterministic order per partition).

    Rows without a known label teach nothing and are left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(label_idx).isNotNull()).withColumns({
        "features": F.col(features), "label_idx": F.col(label_idx).cast("int"), "weight": w, "__key": key if isinstance(key, Column) else F.col(key)})
    return deal(rows.select("features", "label_idx", "weight", "__key"), F.col("__key"), seed, num_partitions).drop("__key")


def deal(df: DataFrame, key: Column, seed: int, num_partitions: int) -> DataFrame:
    """``df`` hash-partitioned and sorted by a seeded hash of ``key``, whatever its columns."""
    h = F.xxhash64(key, F.lit(seed))
    return df.withColumn("__h", h).repartition(num_partitions, "__h").sortWithinPartitions("__h").drop("__h")


def gradient_step(data: DataFrame, states: list[SgdState]) -> list[SgdState]:
    """One full-batch step: the mean gradient over all rows, whatever the partitions.

    Partitions emit gradient sums (configs x K x (F + 1) numbers); the sum of the
    sums over the number of rows is the step that ``local_pass`` takes on one batch
    that holds everything.
    """
    def run(batches):
        total, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, sw = _arrays(batch)
            part = []
            for st in states:
                ypm = np.where(y[:, None] == np.arange(len(st.b))[None, :], 1.0, -1.0)
                g = _dloss(st.config.loss, ypm * (x @ st.w.T + st.b)) * ypm * sw[:, None]
                part.append(np.concatenate((g.sum(axis=0)[:, None], g.T @ x), axis=1))
            total = part if total is None else [a + b for a, b in zip(total, part)]
            n += len(y)
        if n:
            rows = pd.DataFrame([(st.config.name, k, j - 1, float(g[k, j]), n, 1.0) for st, g in zip(states, total)
                                 for k in range(g.shape[0]) for j in range(g.shape[1])],
                                columns=["config", "class_index", "feature_index", "wsum", "n", "steps"])
            yield pa.RecordBatch.from_pandas(rows, schema=_OUT_ARROW, preserve_index=False)

    means = (data.mapInArrow(run, _OUT_SCHEMA).groupBy("config", "class_index", "feature_index")
             .agg((F.sum("wsum") / F.sum("n")).alias("g")).collect())
    by_config = {}
    for r in means:
        if r["g"] is None or not np.isfinite(r["g"]):
            raise ValueError(f"{r['config']}: a gradient is not finite; check features and weights")
        by_config.setdefault(r["config"], {})[r["class_index"], r["feature_index"]] = r["g"]
    out = []
    for st in states:
        g = by_config.get(st.config.name)
        if g is None:
            out.append(st)
            continue
        c, eta = st.config, 1.0 / (st.config.alpha * (st.t + _t0(st.config)))
        w = st.w * max(0.0, 1.0 - eta * c.alpha * (1.0 - c.l1_ratio))
        w = w - eta * np.array([[g[k, j] for j in range(w.shape[1])] for k in range(w.shape[0])])
        if c.l1_ratio > 0:
            w = np.sign(w) * np.maximum(np.abs(w) - eta * c.alpha * c.l1_ratio, 0.0)
        out.append(SgdState(c, w, st.b - eta * np.array([g[k, -1] for k in range(len(st.b))]), st.t + 1.0))
    return out


def init_states(configs: list[SgdConfig], n_classes: int, n_features: int) -> list[SgdState]:
    return [SgdState(c, np.zeros((n_classes, n_features)), np.zeros(n_classes)) for c in configs]


def fit(data: DataFrame, states: list[SgdState], rounds: int) -> list[SgdState]:
    """``rounds`` passes; each is one Spark job plus a small averaging aggregation.

    ``data`` (``features, label_idx, weight``) is computed once: its blocks are kept on disk, as they are read in order.
    """
    blocks = pack(data).persist(StorageLevel.DISK_ONLY)
    try:
        with _bytes_at_once(data.sparkSession, ROUND_BYTES):
            for _ in range(rounds):
                states = _one_round(blocks, states)
    finally:
        blocks.unpersist()
    return states


@contextmanager
def _bytes_at_once(spark, limit: int):
    """Jobs started here hand Python Arrow batches of about ``limit`` bytes at most."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _one_round(blocks: DataFrame, states: list[SgdState]) -> list[SgdState]:
    out = blocks.mapInArrow(_round_fn(states), _OUT_SCHEMA)
    avg = (out.groupBy("config", "class_index", "feature_index")
           .agg((F.sum("wsum") / F.sum("n")).alias("w"), F.max("steps").alias("steps"))
           .collect())
    by_cfg = {s.config.name: s for s in states}
    new_w = {n: s.w.copy() for n, s in by_cfg.items()}
    new_b = {n: s.b.copy() for n, s in by_cfg.items()}
    steps = {n: 0.0 for n in by_cfg}
    for r in avg:
        if r["w"] is None or not np.isfinite(r["w"]):
            raise ValueError(f"{r['config']}: a coefficient is not finite; check features and weights")
        if r["feature_index"] < 0:
            new_b[r["config"]][r["class_index"]] = r["w"]
        else:
            new_w[r["config"]][r["class_index"], r["feature_index"]] = r["w"]
        steps[r["config"]] = max(steps[r["config"]], r["steps"])
    return [SgdState(s.config, new_w[s.config.name], new_b[s.config.name], s.t + steps[s.config.name])
            for s in states]
