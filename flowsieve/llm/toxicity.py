"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters look at a text and vote toxic (1), clean (-1) or not at all (0).  Lexicon
voters hold short built-in word lists, or words and word stems that a bounded
sample of labelled rows shows to go with the label; density voters judge the share
of all such words; pattern voters look at shouting, exclamation marks, masked
words, repetition and direct address.  None is trusted beforehand.

The label model treats the true class as hidden.  Expectation and maximisation
passes over the table of vote patterns of *all* documents estimate, per voter, how
often it votes each way in each class (its accuracy and coverage), and per pair of
voters the correlation of their votes within a class.  A voter's evidence is
divided by one plus its positive correlations, so a cluster of voters that repeat
each other counts little more than one.  Known labels (training rows only) start
the passes and fix their rows' class in them.

A logistic regression on hashed words and stems is then trained on the model's
posteriors of a bounded draw of rows, an equal number from both sides of 0.5; its
intercept is corrected for that draw.  A feature's value is its share of the
text's words, up to a bound, so neither length nor repetition decides alone.

Bounds: at most ``MAX_LABELLED`` labelled rows for the lexicons, at most
``MAX_TRAINED`` rows for the classifier; vote counts, accuracies, correlations
and scores cover all rows.

Edge cases: a null text is empty, an empty text scores the intercept alone;
null labels and labels without a document are ignored; without labels only the
built-in voters vote; repeated and null keys are scored row by row; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ByteCache, Words, forget, keyed, mix, segment_sums, slices, store, trim, worker_cache

MAX_LABELLED = 20_000
MAX_TRAINED = 20_000
BITS = 18
EPOCHS = 3
#: Step, its offset and the L1 and L2 weights of the training.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 5.0, 1e-6
#: A feature that is one in so many words, or more, has the value 1.
FULL = 150
#: Letters of the stems (beginnings) of longer words.
STEMS = (5, 6, 7)
#: Terms learned from labels, and the lexicons that words and stems are dealt into.
TERMS, WORD_LISTS, STEM_LISTS = 240, 8, 4
#: A learned term is in at least this many toxic rows, with a z score and a share of toxic rows of at least these.
LEAST_ROWS, LEAST_Z, LEAST_SHARE = 4, 4.0, 0.5
#: A list votes from one hit in so many words; density voters from these shares, in hits per 1000 words.
ONE_IN, DENSE, SPARSE = 1000, 10, 4
PASSES = 10
#: Votes before any evidence: (rows, share of toxic votes in toxic and in clean texts), likewise clean votes.
PRIOR_ROWS, PRIOR_TOXIC, PRIOR_CLEAN, PRIOR_CLASS = 10.0, (0.3, 0.02), (0.2, 0.8), 0.1

# Common insults and terms of contempt, four languages.
BUILT_IN = (
    ("idiot", "moron", "stupid", "dumb", "fool", "imbecile", "loser", "clown", "dummkopf", "trottel", "blödmann", "dumm",
     "imbécile", "crétin", "abruti", "débile", "idiota", "estúpido", "estúpida", "tonto", "imbécil"),
    ("scum", "trash", "garbage", "filth", "vermin", "worthless", "abschaum", "dreck", "ungeziefer", "wertlos",
     "ordure", "déchet", "vermine", "racaille", "basura", "escoria", "inútil"),
    ("pathetic", "disgusting", "vile", "hateful", "ugly", "widerlich", "erbärmlich", "ekelhaft", "dégoûtant", "minable",
     "pathétique", "asqueroso", "patético", "repugnante"),
)
YOU = ("you", "your", "u", "ya", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "te", "usted", "eres")
PATTERNS = {"exclaiming": "[!?]{2,}", "masked": r"\pL[*#@$%]{2,}\pL", "shouting": r"\b\p{Lu}{3,}\b"}
#: A pattern votes from one match in so many words.
PATTERN_IN = 20

VOTERS = ([f"words_{i}" for i in range(WORD_LISTS)] + [f"stems_{i}" for i in range(STEM_LISTS)]
          + [f"built_in_{i}" for i in range(len(BUILT_IN))]
          + ["dense_words", "dense_stems", "few_words", "few_stems", *PATTERNS, "repeating", "addressing"])
K = len(VOTERS)
POWERS = 3 ** np.arange(K, dtype=np.int64)
_LISTS = WORD_LISTS + STEM_LISTS + len(BUILT_IN)
_YOU = _LISTS


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 5; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5


def letter_words(texts) -> Words:
    """Lower-cased runs of letters."""
    return Words(pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"\PL+", " "))


def terms_of(word: str) -> list[str]:
    """The word, and its stems with a dash."""
    return [word, *(f"{word[:k]}-" for k in STEMS if len(word) > k)]


def _distinct_per_text(w: Words):
    """Number of the text, code of the word and how often, for the distinct words of each text."""
    both, n = np.unique(w.document_of_word() * max(len(w.distinct), 1) + w.codes, return_counts=True)
    return *np.divmod(both, max(len(w.distinct), 1)), n


# lexicons ---------------------------------------------------------------------------------------------------------


def draw_labelled(rows: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``row_id, label`` of at most ``most`` labelled rows, drawn by a hash (stored)."""
    return store(rows.select("row_id", "doc_id").join(known, "doc_id").select("row_id", "label")
                 .orderBy(F.xxhash64("row_id"), "row_id").limit(most), "labelled")


def learn_lexicons(rows: DataFrame, drawn: DataFrame) -> list[tuple[str, bool]]:
    """(term, whether a stem) in falling order of association with the label; at most ``TERMS`` of each kind."""
    def count(batches):
        forget()
        toxic, clean = Counter(), Counter()
        for b in slices(batches):
            w = letter_words(b.column("text"))
            label = b.column("label").to_numpy()
            words = w.distinct.to_pylist()
            doc, code, _ = _distinct_per_text(w)
            ends = np.searchsorted(doc, np.arange(len(w) + 1))
            for i, y in enumerate(label):
                found = {t for c in code[ends[i]:ends[i + 1]].tolist() for t in terms_of(words[c])}
                (toxic if y else clean).update(found)
        names = list(toxic)  # a term without a toxic row is never learned, whatever other tasks say of it
        other = [t for t in clean if t not in toxic]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names + other, pa.string()), pa.array([toxic[t] for t in names] + [0] * len(other), pa.int64()),
             pa.array([clean[t] for t in names + other], pa.int64())], ["term", "toxic", "clean"])
        trim()

    totals = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    labelled = rows.select("row_id", "text").join(F.broadcast(drawn), "row_id")  # at most MAX_LABELLED rows
    counts = (labelled.mapInArrow(count, "term string, toxic long, clean long").groupBy("term")
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= LEAST_ROWS))
    p, q = (F.col("toxic") + 0.5) / (n1 + 1), (F.col("clean") + 0.5) / (n0 + 1)
    z = (F.log(p / (1 - p)) - F.log(q / (1 - q))) / F.sqrt(
        1 / (F.col("toxic") + 0.5) + 1 / (n1 - F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5) + 1 / (n0 - F.col("clean") + 0.5))
    share = F.col("toxic") / n1 / (F.col("toxic") / n1 + F.col("clean") / n0)
    strong = counts.withColumn("z", z).withColumn("stem", F.col("term").endswith("-")) \
        .filter((F.col("z") >= LEAST_Z) & (share >= LEAST_SHARE))
    best = strong.filter("not stem").orderBy(F.desc("z"), "term").limit(TERMS).unionByName(
        strong.filter("stem").orderBy(F.desc("z"), "term").limit(TERMS))
    found = sorted(((r["z"], r["term"], r["stem"]) for r in best.collect()), key=lambda x: (-x[0], x[1]))
    return [(t, s) for _, t, s in found]


def lexicon_bits(terms: list[tuple[str, bool]]) -> dict[str, int]:
    """Bit set of the lists that hold a term: strong and weak terms are dealt alike over the lists of their kind."""
    bits: dict[str, int] = {}
    place = {False: 0, True: 0}
    for t, stem in terms:
        i = WORD_LISTS + place[True] % STEM_LISTS if stem else place[False] % WORD_LISTS
        place[stem] += 1
        bits[t] = bits.get(t, 0) | 1 << i
    for i, words in enumerate(BUILT_IN):
        for t in words:
            bits[t] = bits.get(t, 0) | 1 << (WORD_LISTS + STEM_LISTS + i)
    for t in YOU:
        bits[t] = bits.get(t, 0) | 1 << _YOU
    return bits


# voters -----------------------------------------------------------------------------------------------------------


def votes(texts, bits: dict[str, int]) -> np.ndarray:
    """Votes (-1, 0, 1) of all voters, one row per text."""
    def masks(words):
        out = []
        for word in words:
            m = 0
            for t in terms_of(word):
                m |= bits.get(t, 0)
            out.append(m)
        return out

    w = letter_words(texts)
    cache = worker_cache(("votes", len(bits), zlib.crc32(repr(sorted(bits)).encode())), lambda: ByteCache(24 << 20))
    mask = np.array(cache.lookup(w.distinct.to_pylist(), masks), np.int64)[w.codes] if len(w.codes) else np.zeros(0, np.int64)
    n = np.diff(w.offsets)
    hit = np.flatnonzero(mask)
    doc, mask = np.searchsorted(w.offsets, hit, "right") - 1, mask[hit]
    hits = np.stack([np.bincount(doc[mask >> i & 1 == 1], minlength=len(n)) for i in range(_LISTS + 1)], axis=1)
    group = [mask & (1 << WORD_LISTS) - 1, mask >> WORD_LISTS & (1 << STEM_LISTS) - 1]
    words, stems = (np.bincount(doc[g > 0], minlength=len(n)) for g in group)
    out = np.zeros((len(n), K), np.int8)
    out[:, :_LISTS] = (hits[:, :_LISTS] > 0) & (hits[:, :_LISTS] * ONE_IN >= n[:, None])
    at = _LISTS
    for found in (words, stems):
        out[:, at] = (found > 0) & (found * 1000 >= DENSE * n)
        out[:, at + 2] = -(found * 1000 <= SPARSE * n).astype(np.int8)
        at += 1
    at = _LISTS + 4
    for pattern in PATTERNS.values():
        found = pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
        out[:, at] = (found > 0) & (found * PATTERN_IN >= n)
        at += 1
    same = w.within(3)
    if len(same) > 2:
        same[:-2] &= (w.codes[2:] == w.codes[1:-1]) & (w.codes[1:-1] == w.codes[:-2])
    found = segment_sums(same.astype(np.int64), w.offsets)
    out[:, at] = (found > 0) & (found * PATTERN_IN >= n)
    built = hits[:, WORD_LISTS + STEM_LISTS:_LISTS].sum(axis=1)
    out[:, at + 1] = (built > 0) & (hits[:, _YOU] > 0) & (built * ONE_IN >= n)
    return out


def pack_votes(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ POWERS


def unpack_votes(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // POWERS % 3 - 1).astype(np.int8)


def cast_votes(rows: DataFrame, bits: dict[str, int]) -> DataFrame:
    """``row_id, doc_id, pattern`` of every row: all votes on a whole text in one long (stored)."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # a few hundred terms

    def run(batches):
        for b in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"),
                                              pa.array(pack_votes(votes(b.column("text"), shared.value)))],
                                             ["row_id", "doc_id", "pattern"])
        trim()

    return store(rows.select("row_id", "doc_id", "text").mapInArrow(run, "row_id long, doc_id long, pattern long"), "votes")


# label model ------------------------------------------------------------------------------------------------------


class LabelModel:
    """Class share, vote shares per class and voter, and correlations of voters within the classes."""

    def __init__(self):
        self.share = PRIOR_CLASS
        start = np.zeros((2, K, 3))  # class, voter, vote + 1
        for j, name in enumerate(VOTERS):
            up, down = ((0.0, 0.0), PRIOR_CLEAN) if name.startswith("few_") else (PRIOR_TOXIC, (0.0, 0.0))
            for c, at in ((1, 0), (0, 1)):
                start[c, j] = (down[at], 1 - up[at] - down[at], up[at])
        self.prior = start * PRIOR_ROWS + 0.1
        self.vote_share = self.prior / self.prior.sum(axis=2, keepdims=True)
        self.correlation = np.eye(K)
        self.weight = np.ones(K)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of toxic, given votes."""
        ratio = np.log(self.vote_share[1]) - np.log(self.vote_share[0])
        evidence = (ratio[np.arange(K), v + 1] * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(evidence + math.log(self.share / (1 - self.share)), -35, 35)))

    def statistics(self, v: np.ndarray, n: np.ndarray, label: np.ndarray, known_only: bool) -> np.ndarray:
        """Sums that ``update`` needs, flat: per class rows, votes by kind, and products of votes of all pairs."""
        p = np.where(label >= 0, label, 0.0 if known_only else self.posterior(v))
        n = np.where(label >= 0, n, 0 if known_only else n)
        out = []
        for c in (p * 0 + 1 - p, p):
            w = c * n
            kinds = np.stack([(w[:, None] * (v == x)).sum(axis=0) for x in (-1, 0, 1)], axis=1)
            x = v.astype(float)
            out += [np.array([w.sum()]), kinds.ravel(), (x.T @ (w[:, None] * x)).ravel()]
        return np.concatenate(out)

    def update(self, total: np.ndarray, correlations: bool = True) -> None:
        size = 1 + 3 * K + K * K
        pooled, weight = np.zeros((K, K)), 0.0
        rows = np.zeros(2)
        for c in (0, 1):
            part = total[c * size:(c + 1) * size]
            rows[c], kinds = part[0], part[1:1 + 3 * K].reshape(K, 3) + self.prior[c]
            self.vote_share[c] = kinds / kinds.sum(axis=1, keepdims=True)
            if part[0] > 0:
                seen = part[1:1 + 3 * K].reshape(K, 3)
                mean = (seen[:, 2] - seen[:, 0]) / part[0]
                cov = part[1 + 3 * K:].reshape(K, K) / part[0] - np.outer(mean, mean)
                spread = np.sqrt(np.maximum(np.diag(cov), 0))
                usual = np.outer(spread, spread)
                # both classes count alike, however rare one is
                pooled += np.where(usual > 1e-12, cov / np.maximum(usual, 1e-12), 0)
                weight += 1
        self.share = float(np.clip((rows[1] + PRIOR_CLASS) / (rows.sum() + 1), 1e-6, 1 - 1e-6))
        if correlations and weight:
            self.correlation = pooled / weight
            np.fill_diagonal(self.correlation, 1.0)
            self.weight = 1 / np.maximum(self.correlation, 0).sum(axis=1)


def fit_label_model(patterns: DataFrame, passes: int = PASSES) -> LabelModel:
    """Model from ``pattern, label, n`` (label null where unknown), a stored table."""
    model = LabelModel()

    def one(known_only: bool):
        def run(batches):
            forget()
            total = np.zeros(2 * (1 + 3 * K + K * K))
            for b in batches:
                v = unpack_votes(b.column("pattern").to_numpy())
                label = pc.fill_null(b.column("label"), -1).to_numpy().astype(float)
                total += model.statistics(v, b.column("n").to_numpy().astype(float), label, known_only)
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])
        got = patterns.mapInArrow(run, "total array<double>").collect()  # one row of fixed size per task
        return np.sum([np.array(r["total"]) for r in got], axis=0) if got else None

    start = one(True)
    if start is None:
        return model
    if start[0] and start[len(start) // 2]:  # labels of both classes
        model.update(start)
    for _ in range(passes):
        model.update(one(False))
    return model


# classifier -------------------------------------------------------------------------------------------------------


def _word_features(words: list[str]) -> list[tuple[int, ...]]:
    return [tuple(zlib.crc32(t.encode()) for t in terms_of(w)) for w in words]


def _features(w: Words, bits: int):
    """Feature numbers of the distinct words, flat, and each word's borders."""
    known = _word_features(w.distinct.to_pylist())
    flat = np.fromiter(chain.from_iterable(known), np.uint64)
    borders = np.concatenate(([0], np.cumsum([len(k) for k in known], dtype=np.int64)))
    return _number(flat, bits), borders.astype(np.int64)


def _number(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes + np.uint64(11)) >> np.uint64(64 - bits)).astype(np.int64)


def train_soft(rows, bits: int, epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """Intercept and weights from (posterior, feature numbers, values): expected log loss, proximal steps, L1."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for y, at, x in rows:
            w, wb = weights(z[at], n[at]), -zb * ALPHA / (BETA + math.sqrt(nb))
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, wb + float(w @ x))))) - y
            grown = n[at] + (g * x) ** 2
            z[at] += g * x - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / ALPHA * wb
            nb += g * g
    return -zb * ALPHA / (BETA + math.sqrt(nb)), weights(z, n)


def fit_classifier(rows: DataFrame, cast: DataFrame, model: LabelModel, most: int = MAX_TRAINED,
                   bits: int = BITS) -> tuple[float, np.ndarray]:
    """Intercept and weights of the linear classifier."""
    def judge(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("row_id"), pa.array(model.posterior(unpack_votes(b.column("pattern").to_numpy())))], ["row_id", "p"])

    judged = cast.select("row_id", "pattern").mapInArrow(judge, "row_id long, p double")
    side = (F.col("p") >= 0.5).cast("int")
    size = {r["side"]: r["count"] for r in judged.groupBy(side.alias("side")).count().collect()}
    half, order = most // 2, (F.xxhash64("row_id"), F.col("row_id"))
    drawn = store(judged.filter("p >= 0.5").orderBy(*order).limit(half).unionByName(
        judged.filter("p < 0.5").orderBy(*order).limit(half)), "posteriors")

    def vectors(batches):
        for b in slices(batches, limit=1 << 20):
            w = letter_words(b.column("text"))
            number, borders = _features(w, bits)
            doc, code, times = _distinct_per_text(w)
            ends = np.searchsorted(doc, np.arange(len(w) + 1))
            out = []
            for i in range(len(w)):
                c, t = code[ends[i]:ends[i + 1]], times[ends[i]:ends[i + 1]]
                per = borders[c + 1] - borders[c]
                at = np.repeat(borders[c] - (np.cumsum(per) - per), per) + np.arange(per.sum())
                f, where = np.unique(number[at], return_inverse=True)
                x = np.minimum(np.bincount(where, np.repeat(t, per), len(f)) * (FULL / max(int(t.sum()), 1)), 1.0)
                out.append(f.astype("<u4").tobytes() + x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("p"), pa.array(out, pa.binary())],
                                             ["row_id", "p", "vector"])
        trim()

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((group["row_id"], mix(group["row_id"].to_numpy().astype(np.uint64) + np.uint64(7))))
        sparse = []
        for i in order:
            v = group["vector"].iloc[i]
            sparse.append((float(group["p"].iloc[i]), np.frombuffer(v, "<u4", len(v) // 8).astype(np.int64),
                           np.frombuffer(v, "<f4", offset=len(v) // 2)))
        bias, w = train_soft(sparse, bits)
        return pd.DataFrame({"bias": [bias], "weights": [w.astype("<f4").tobytes()]})

    sample = rows.select("row_id", "text").join(F.broadcast(drawn), "row_id")  # at most ``most`` rows
    got = (sample.mapInArrow(vectors, "row_id long, p double, vector binary").withColumn("one", F.lit(1))
           .groupBy("one").applyInPandas(learn, "bias double, weights binary").collect())
    if not got:
        return 0.0, np.zeros(1 << bits, "<f4")
    # the draw took a larger part of one side than of the other; the intercept alone depends on that
    taken = {s: min(half, n) / n for s, n in size.items()}
    return got[0]["bias"] + math.log(taken.get(0, 1.0) / taken.get(1, 1.0)), np.frombuffer(got[0]["weights"], "<f4")


def score(rows: DataFrame, classifier: tuple[float, np.ndarray]) -> DataFrame:
    """``doc_id, score`` of every row."""
    bias, weights = classifier
    bits = len(weights).bit_length() - 1
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # 4 << bits bytes

    name = zlib.crc32(weights.tobytes())

    def weighty(words):
        """Of each word the features that have a weight; most have none."""
        known = _word_features(words)
        flat = np.fromiter(chain.from_iterable(known), np.uint64)
        number = _number(flat, bits)
        owner = np.repeat(np.arange(len(known)), [len(k) for k in known])
        out = [()] * len(known)
        for at in np.flatnonzero(shared.value[number]).tolist():
            out[owner[at]] += (int(number[at]),)
        return out

    def run(batches):
        for b in slices(batches, limit=1 << 20):
            w = letter_words(b.column("text"))
            known = worker_cache(("toxic-score", name), lambda: ByteCache(16 << 20)).lookup(w.distinct.to_pylist(), weighty)
            n, weight = np.diff(w.offsets), shared.value
            number = np.fromiter(chain.from_iterable(known), np.int64)
            borders = np.concatenate(([0], np.cumsum(np.fromiter(map(len, known), np.int64, len(known)))))
            per = np.diff(borders)[w.codes] if len(w.codes) else np.zeros(0, np.int64)
            hit = np.flatnonzero(per)  # words with a feature that has a weight
            per = per[hit]
            doc = np.repeat(np.searchsorted(w.offsets, hit, "right") - 1, per)
            f = number[np.repeat(borders[w.codes[hit]] - (np.cumsum(per) - per), per) + np.arange(per.sum())]
            both, times = np.unique(doc << bits | f, return_counts=True)
            doc, f = both >> bits, both & (1 << bits) - 1
            total = np.bincount(doc, np.minimum(times * FULL / n[doc], 1.0) * weight[f], len(n))
            p = 1 / (1 + np.exp(-np.clip(bias + total, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], ["doc_id", "score"])
        trim()

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             max_labelled: int = MAX_LABELLED, max_trained: int = MAX_TRAINED) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``; ``labels`` has ``doc_id, label`` (1: toxic) of rows to learn from."""
    rows = keyed(docs, key, text)
    known = (labels.filter("label in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max("label").cast("int").alias("label")))
    bits = lexicon_bits(learn_lexicons(rows, draw_labelled(rows, known, max_labelled)))
    cast = cast_votes(rows, bits)
    patterns = store(cast.select("doc_id", "pattern").join(known, "doc_id", "left").groupBy("pattern", "label")
                     .agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    model = fit_label_model(patterns)
    return score(rows, fit_classifier(rows, cast, model, max_trained))
