"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Every word stands for itself and for its shape (runs of upper case, lower case,
digits and other characters, symbols kept); words and shapes, alone and in
pairs, are hashed into ``1 << bits`` weights.  A text's score is the logistic
function of a bias and the mean weight of its n-grams (a sparse dot product with
their relative frequencies), so length alone decides nothing.

Training reads at most ``max_rows`` labelled rows, drawn by a hash of the key;
their whole texts become sparse vectors in parallel, and one task runs the
sequential FTRL updates (McMahan et al. 2013) over that bounded sample.  The
model is ``1 << bits`` floats whatever the input size, and scoring is one narrow
pass over all documents.

Edge cases: null text is empty; an empty text has the score of the bias alone;
null labels and labels without a document are ignored; without any usable label
every score is 0.5; rows with the same key are scored one by one; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TwoAges, Words, mix, slices, worker_cache

BITS = 20
MAX_ROWS = 20_000
EPOCHS = 3
#: FTRL: learning rate, its offset, and the two regularisations.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-6, 1e-6
#: The mean weight is multiplied by this, so that steps reach the score.
SCALE = 10.0

_SHAPE = re.compile(r"[A-Z]+|[a-z]+|[0-9]+")


def shape(word: str) -> str:
    """Runs of letters and digits by kind; everything else stays."""
    def run(m):
        c = m[0][0]
        return "X" if c.isupper() else "x" if c.islower() else "0"
    plain = "".join("A" if c.isupper() else "a" if c.isalpha() and not c.isascii() else c for c in word) \
        if not word.isascii() else word
    return re.sub(r"(.)\1+", r"\1", _SHAPE.sub(run, plain))


def _hashes() -> TwoAges:
    return worker_cache("hashes", lambda: TwoAges(100_000))


def _hash_words(words: list[str]) -> list[tuple[int, int]]:
    return [(zlib.crc32(w.encode()), zlib.crc32(shape(w).encode()) + (1 << 32)) for w in words]


def features(texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts in a row, and the n + 1 borders between texts."""
    w = Words(texts)
    known = np.array(_hashes().lookup(w.distinct.to_pylist(), _hash_words), np.uint64).reshape(-1, 2)
    word, form = mix(known[w.codes, 0] + np.uint64(1)), mix(known[w.codes, 1] + np.uint64(1))
    n = len(word)
    pair = w.within(2)
    nxt = np.minimum(np.arange(n) + 1, max(n - 1, 0))
    both = np.stack([word, form, mix(word ^ (word[nxt] << np.uint64(1))), mix(form ^ (form[nxt] << np.uint64(1)))], axis=1)
    valid = np.stack([np.ones(n, bool), np.ones(n, bool), pair, pair], axis=1)
    size = np.where(np.diff(w.offsets) > 0, 4 * np.diff(w.offsets) - 2, 0)
    return (both[valid] >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(([0], np.cumsum(size)))


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """Bias and weights from (label, feature numbers, values); each row is one update."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    for _ in range(epochs):
        for y, at, x in rows:
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))
            wb = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(wb + w @ x, -35, 35)))
            g = (p - y) * x
            grown = na + g * g
            z[at] = za + g - (np.sqrt(grown) - np.sqrt(na)) / ALPHA * w
            n[at] = grown
            gb = p - y
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / ALPHA * wb
            nb += gb * gb
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return -zb / ((BETA + np.sqrt(nb)) / ALPHA), w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS,
        max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """Model from ``labels`` (``doc_id``, ``label`` 0 or 1); at most ``max_rows`` of them are used."""
    drawn = (labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .join(F.broadcast(drawn), "doc_id")  # at most max_rows rows

    def vectors(batches):
        for b in slices(batches):
            found, borders = features(b.column("text"), bits)
            out = []
            for s, e in zip(borders[:-1], borders[1:]):
                at, count = np.unique(found[s:e], return_counts=True)
                out.append(at.astype("<u4").tobytes() + (SCALE * count / max(e - s, 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(out, pa.binary())],
                                             ["doc_id", "label", "vector"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", key=lambda s: mix(s.to_numpy().astype(np.uint64) + np.uint64(7)))
        sparse = [(int(y), np.frombuffer(v, "<u4", len(v) // 8).astype(np.int64), np.frombuffer(v, "<f4", offset=len(v) // 2))
                  for y, v in zip(group["label"], group["vector"])]
        bias, weights = train_ftrl(sparse, bits, epochs)
        return pd.DataFrame({"bias": [float(bias)], "weights": [weights.astype("<f4").tobytes()]})

    model = (rows.mapInArrow(vectors, "doc_id long, label int, vector binary").withColumn("one", F.lit(1))
             .groupBy("one").applyInPandas(learn, "bias double, weights binary").collect())
    if not model:
        return 0.0, np.zeros(1 << bits, "<f4")
    return model[0]["bias"], np.frombuffer(model[0]["weights"], "<f4")


def score(docs: DataFrame, model: tuple[float, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    bias, weights = model
    bits = len(weights).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 << bits bytes

    def run(batches):
        w = shared.value
        for b in slices(batches):
            found, borders = features(b.column("text"), bits)
            total = np.concatenate(([0.0], np.cumsum(w[found], dtype=np.float64)))
            mean = (total[borders[1:]] - total[borders[:-1]]) / np.maximum(np.diff(borders), 1)
            p = 1 / (1 + np.exp(-np.clip(bias + SCALE * mean, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .mapInArrow(run, "doc_id long, score double")


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 3; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3
