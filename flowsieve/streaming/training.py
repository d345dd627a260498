"""Incremental training: every micro-batch continues the stored model, exactly once.

The model of a version is a coefficient table with the step count of its learning
rate; version = batch number.  A batch starts from the last committed version, not
from anything the driver remembers, so a run that is stopped and restarted goes on
where it was, and a batch that is run again is not applied twice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sgd
from .store import BatchStore

MODEL = ("model string, loss string, penalty string, alpha double, vote_weight double, steps double, class_index int, "
         "feature_index int, weight double")


def model_rows(states: list[sgd.SgdState]) -> list[tuple]:
    """Coefficients of all models, the intercept as feature -1 (bounded by the model)."""
    out = []
    for s in states:
        c = s.config
        head = (c.name, c.loss, c.penalty, float(c.alpha), float(c.vote_weight), float(s.t))
        for k in range(len(s.b)):
            out.append((*head, k, -1, float(s.b[k])))
            out += [(*head, k, j, float(x)) for j, x in enumerate(s.w[k])]
    return out


def states_of(rows, configs: list[sgd.SgdConfig]) -> list[sgd.SgdState]:
    """States of ``configs`` from collected model rows; a lost coefficient is an error."""
    held: dict[str, dict] = {}
    for r in rows:
        held.setdefault(r["model"], {})[r["class_index"], r["feature_index"]] = (r["weight"], r["steps"])
    out = []
    for c in configs:
        own = held.get(c.name)
        if own is None:
            raise ValueError(f"the stored model has no {c.name}")
        k, f = (1 + max(i[axis] for i in own) for axis in (0, 1))
        if len(own) != k * (f + 1):
            raise ValueError(f"{c.name}: {len(own)} of {k * (f + 1)} coefficients are stored")
        w = np.array([[own[i, j][0] for j in range(f)] for i in range(k)])
        out.append(sgd.SgdState(c, w, np.array([own[i, -1][0] for i in range(k)]), own[0, -1][1]))
    return out


class TrainingStream:
    """Models kept under ``root``; ``vectors(batch, seed, partitions)`` gives ``features, label_idx, weight`` of a
    micro-batch, dealt like ``sgd.prepare``."""

    def __init__(self, spark: SparkSession, root: str, configs: list[sgd.SgdConfig], n_classes: int, n_features: int,
                 vectors: Callable[[DataFrame, int, int], DataFrame], rounds: int, seed: int = 42, partitions: int | None = None):
        self.spark, self.configs, self.vectors = spark, configs, vectors
        self.shape, self.rounds, self.seed, self.partitions = (n_classes, n_features), rounds, seed, partitions
        self.store = BatchStore(spark, root)
        self.schema = spark.createDataFrame([], MODEL).schema

    def model(self) -> list[sgd.SgdState]:
        """The last committed version, or the untrained start."""
        head = self.store.head()
        if head is None:
            return sgd.init_states(self.configs, *self.shape)
        return states_of(self.store.read("model", self.schema, head["batch"]).collect(), self.configs)

    def apply(self, batch: DataFrame, number: int) -> None:
        """What ``foreachBatch`` calls."""
        if self.store.done(number):
            return
        n = self.partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        states = sgd.fit(self.vectors(batch, self.seed, n), self.model(), self.rounds)
        self.store.write("model", self.spark.createDataFrame(model_rows(states), MODEL), number)
        self.before_commit(number)
        self.store.commit(number)

    def before_commit(self, number: int) -> None:
        """Called when a version is written but not yet valid."""

    def versions(self) -> DataFrame:
        """All committed versions, with their ``version``."""
        rows = self.store.read("model", self.schema)
        batch = F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("long")
        return rows.select("*", batch.alias("version")) if self.store.head() else rows.withColumn("version", F.lit(0).cast("long"))
