"""Weak supervision: votes by hand, the label model on simulated voters, the classifier by loop, held-out quality."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_ORACLE, SF_SMALL
from flowsieve.llm import queries
from flowsieve.llm import toxicity as tox

SCHEMA = "doc_id long, text string, score string, row_id long, label string, pattern int"


def votes_by_hand(text, bits):
    words = re.findall(r"[^\W\d_]+", text.lower())
    n = len(words)
    hits = [0] * (tox._LISTS + 1)
    learned = [0, 0]
    for w in words:
        m = 0
        for t in [w, *(w[:k] + "-" for k in tox.STEMS if len(w) > k)]:
            m |= bits.get(t, 0)
        for i in range(len(hits)):
            hits[i] += m >> i & 1
        learned[0] += any(m >> i & 1 for i in range(tox.WORD_LISTS))
        learned[1] += any(m >> i & 1 for i in range(tox.WORD_LISTS, tox.WORD_LISTS + tox.STEM_LISTS))
    out = [int(h > 0 and h * 1000 >= n) for h in hits[:-1]]
    out += [int(x > 0 and x * 1000 >= 10 * n) for x in learned] + [-int(x * 1000 <= 4 * n) for x in learned]
    found = [len(re.findall("[!?]{2,}", text)), len(re.findall(r"[^\W\d_][*#@$%]{2,}[^\W\d_]", text)),
             len(re.findall(r"\b[A-Z]{3,}\b", text)),
             sum(words[i] == words[i + 1] == words[i + 2] for i in range(n - 2))]
    out += [int(x > 0 and x * 20 >= n) for x in found]
    built = sum(hits[tox.WORD_LISTS + tox.STEM_LISTS:-1])
    return out + [int(built > 0 and hits[-1] > 0 and built * 1000 >= n)]


def test_votes():
    bits = tox.lexicon_bits([("gromble", False), ("zork", False), ("blathe-", True), ("quinte-", True), ("snarf", False)])
    texts = ["", "  ", "you IDIOT!! you absolute idiot", "a gromble b " * 3 + "c " * 3000, "blatherer and quintessence zork",
             "x**x y##y z", "AAA BBB ccc", "ha ha ha ha no", "quinte", "Snarf. snarf, SNARF!?", "ha ha", "ha", "plain words only here"]
    got = tox.votes(pa.array(texts), bits)
    assert got.tolist() == [votes_by_hand(t, bits) for t in texts]
    assert tox.unpack_votes(tox.pack_votes(got)).tolist() == got.tolist()


def test_label_model_finds_accuracies_and_correlations(spark):
    rng = np.random.default_rng(4)
    n = 20_000
    y = (rng.random(n) < 0.2).astype(int)
    v = np.zeros((n, tox.K), np.int8)
    up, wrong = rng.uniform(0.3, 0.7, tox.K), rng.uniform(0.005, 0.05, tox.K)
    for j in range(8):
        v[:, j] = rng.random(n) < np.where(y == 1, up[j], wrong[j])
    v[:, 8] = v[:, 7]  # a voter that repeats another
    v[:, 9] = rng.random(n) < 0.1  # one that knows nothing
    label = np.where(rng.random(n) < 0.05, y, -1)
    rows = {}
    for p, x in zip(tox.pack_votes(v).tolist(), label.tolist()):
        rows[p, x] = rows.get((p, x), 0) + 1
    patterns = spark.createDataFrame([(p, None if x < 0 else x, k) for (p, x), k in rows.items()],
                                     "pattern long, label int, n long").repartition(3)
    model = tox.fit_label_model(patterns)
    assert abs(model.share - 0.2) < 0.03
    assert np.abs(model.vote_share[1][:8, 2] - up[:8]).max() < 0.06
    assert np.abs(model.vote_share[0][:8, 2] - wrong[:8]).max() < 0.02
    assert abs(model.vote_share[1][9, 2] - model.vote_share[0][9, 2]) < 0.03
    assert model.correlation[7, 8] > 0.95 and abs(model.correlation[0, 1]) < 0.1
    assert abs(model.weight[7] - 0.5) < 0.1 and model.weight[0] > 0.8
    right = (model.posterior(v) >= 0.5) == y
    assert right.mean() > 0.95


def test_training_by_loop():
    rng = np.random.default_rng(2)
    rows = [(float(rng.random()), np.sort(rng.choice(16, 5, replace=False)), rng.random(5)) for _ in range(60)]
    bias, got = tox.train_soft(rows, 4, 2)
    z, n, zb, nb = [0.0] * 16, [0.0] * 16, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= tox.L1:
            return 0.0
        return -(z[i] - math.copysign(tox.L1, z[i])) / ((tox.BETA + math.sqrt(n[i])) / tox.ALPHA + tox.L2)

    for _ in range(2):
        for y, at, x in rows:
            w = {int(i): weight(i) for i in at}
            wb = -zb * tox.ALPHA / (tox.BETA + math.sqrt(nb))
            g = 1 / (1 + math.exp(-(wb + sum(w[int(i)] * v for i, v in zip(at, x))))) - y
            for i, v in zip(at, x):
                step = (math.sqrt(n[i] + (g * v) ** 2) - math.sqrt(n[i])) / tox.ALPHA
                z[i] += g * v - step * w[int(i)]
                n[i] += (g * v) ** 2
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / tox.ALPHA * wb
            nb += g * g
    assert np.allclose(got, [weight(i) for i in range(16)]) and abs(bias + zb * tox.ALPHA / (tox.BETA + math.sqrt(nb))) < 1e-9


def test_scores_by_loop(spark):
    weights = np.zeros(1 << tox.BITS, "<f4")
    slot = lambda t: int(tox.mix(np.array([zlib.crc32(t.encode()) + 11], np.uint64))[0] >> np.uint64(64 - tox.BITS))
    for t, w in (("idiot", 2.0), ("blathe-", 1.5), ("blather-", -0.5), ("nice", -3.0)):
        weights[slot(t)] = w
    texts = ["", "idiot", "nice idiot", "blathering blatherer is nice", "idiot " + "word " * 900, None, "none of them"]
    rows = spark.createDataFrame([(i, i, t or "") for i, t in enumerate(texts)], "row_id long, doc_id long, text string")
    got = {r.doc_id: r.score for r in tox.score(rows, (-1.0, weights)).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        total, share = -1.0, {}
        for w in words:
            for f in tox.terms_of(w):
                share[slot(f)] = share.get(slot(f), 0) + 1
        total += sum(float(weights[f]) * min(1.0, k * tox.FULL / len(words)) for f, k in share.items())
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-6


def test_held_out_quality(spark):
    got = queries.QUERIES["op12_toxicity"](spark, SF_ORACLE)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF_ORACLE}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    clean = [p for p, t in held if not t]
    assert sum(clean) / len(clean) < 0.03


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, labelled):
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(120).collect()
    rows = [(r.doc_id, r.text, "x", 1, "y", 2) for r in base]
    rows += [(None, "you idiot", "x", 1, "y", 2), (None, None, "x", 1, "y", 2), (5, "", None, 1, "y", 2), (5, "", None, 1, "y", 2),
             (90_001, "stupid worthless scum you are, idiot!!", "x", 1, "y", 2), (90_002, "word " * 200_000, "x", 1, "y", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = [(r.doc_id, int("idiot" in (r.text or ""))) for r in base] + [(5, None), (None, 1), (777_777, 1)] if labelled else []
    got = tox.toxicity(docs, spark.createDataFrame(labels, "doc_id long, label int")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5 and r.score is not None}) >= 1
    none = spark.createDataFrame([], SCHEMA)
    assert tox.toxicity(none, spark.createDataFrame(labels, "doc_id long, label int")).collect() == []
