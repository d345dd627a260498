"""Hard-negative mining with exact integer scores from Kronecker-packed products.

A component ``x`` becomes ``floor(256 * x)``; the score of two rows is the inner
product of those integers.  Scores are computed block by block: components of
candidates and anchors are biased to be non-negative, several candidates are
packed into the fields of one wide integer (``c0 + c1 << w + ...``), every anchor
component is multiplied with that integer once, and the summed fields, which
cannot run into each other, are unpacked and freed of the bias.  ``w`` comes from
the largest values of the block.  Wide integers of up to 53 bits are held in
doubles, where sums below ``2**53`` are exact and BLAS multiplies them; where two
fields do not fit, they are Python integers of any width.

A fixed set of anchors meets all rows, so the work is anchors times rows and no
join is needed: anchors are cut into chunks of bounded bytes, each chunk is
broadcast, and every task keeps the best few rows per anchor of its own rows.
What tasks emit (at most ``depth`` rows per anchor and task) is ranked per
anchor.  The first pass finds the positives, the second the negatives below each
positive's score.  No group of rows (a label, a key) is ever brought together.

Edge cases: rows without key, label or vector, or with a null or non-finite
component (also after the scaling) take no part; rows that share a key count one
by one, as anchors too, but a row never meets rows of its own key; only vectors
of equal length are compared, and empty vectors score 0; scores saturate at
``2**60``; an empty table, or one without anchors, gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, store, trim

SCALE = 256
#: Positives per anchor, and negatives per positive.
DEPTH = 5
#: A negative has at least this share of the positive's score, in percent.
LEAST_PERCENT = 80
#: Bytes of vectors of one broadcast chunk of anchors.
CHUNK_BYTES = 16 << 20
#: Bits of integers that doubles hold exactly.
EXACT = 53
#: Fields of a wide integer where doubles are too short.
WIDE_FIELDS = 32
LIMIT = 1 << 60
#: Rows of a block of anchors, and of candidates.
ANCHORS, CANDIDATES = 1024, 2048


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products (int64, saturated) of the rows of two matrices of whole numbers held as doubles."""
    (m, d), n = anchors.shape, len(candidates)
    if not (m and n and d):
        return np.zeros((m, n), np.int64)
    low_a, low_c = min(0, int(anchors.min())), min(0, int(candidates.min()))
    high_a, high_c = max(0, int(anchors.max())), max(0, int(candidates.max()))
    width = max(1, (d * (high_a - low_a) * (high_c - low_c)).bit_length())
    fields = min(EXACT // width, n)
    if EXACT // width < 2:
        return _wide_scores(anchors, candidates, low_a, low_c, width)
    groups = -(-n // fields)
    padded = np.zeros((groups * fields, d))
    padded[:n] = candidates - low_c
    shift = np.exp2(width * np.arange(fields))
    wide = np.einsum("gfd,f->dg", padded.reshape(groups, fields, d), shift)
    product = ((anchors - low_a) @ wide).astype(np.int64)
    out = np.empty((m, groups, fields), np.int64)
    for f in range(fields):
        out[:, :, f] = product >> (width * f)
    out &= (1 << width) - 1
    out = out.reshape(m, -1)[:, :n]
    # sum((a - la) * (c - lc)) = score - lc * sum(a) - la * sum(c) + d * la * lc
    out += (low_c * anchors.sum(axis=1).astype(np.int64))[:, None]
    out += (low_a * candidates.sum(axis=1).astype(np.int64) - d * low_a * low_c)[None, :]
    return np.clip(out, -LIMIT, LIMIT)


def _wide_scores(anchors, candidates, low_a: int, low_c: int, width: int) -> np.ndarray:
    """The same with wide integers of any length."""
    own = [[int(x) for x in row] for row in anchors]
    out = np.empty((len(anchors), len(candidates)), np.int64)
    mask = (1 << width) - 1
    for at in range(0, len(candidates), WIDE_FIELDS):
        part = [[int(x) for x in row] for row in candidates[at:at + WIDE_FIELDS]]
        wide = [sum((c - low_c) << (width * f) for f, c in enumerate(column)) for column in zip(*part)]
        back = [low_a * sum(row) - len(row) * low_a * low_c for row in part]
        for i, row in enumerate(own):
            product = sum((a - low_a) * w for a, w in zip(row, wide))
            more = low_c * sum(row)
            out[i, at:at + len(part)] = [max(-LIMIT, min(LIMIT, (product >> (width * f) & mask) + more + back[f]))
                                         for f in range(len(part))]
    return out


class Best:
    """The ``depth`` best rows of each of ``n`` groups: higher scores first, then smaller keys."""

    def __init__(self, n: int, depth: int):
        self.depth, self.count = depth, np.zeros(n, np.int64)
        self.score, self.key = np.zeros((n, depth), np.int64), np.zeros((n, depth), np.int64)

    def least(self) -> np.ndarray:
        """Scores below this cannot enter a group."""
        return np.where(self.count == self.depth, self.score[:, -1], -LIMIT)

    def offer(self, group: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        touched = np.unique(group)
        held = np.arange(self.depth) < self.count[touched, None]
        group = np.concatenate((np.repeat(touched, self.count[touched]), group))
        score = np.concatenate((self.score[touched][held], score))
        key = np.concatenate((self.key[touched][held], key))
        order = np.lexsort((key, ~score, group))
        group, score, key = group[order], score[order], key[order]
        first = np.searchsorted(group, touched)
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        keep = rank < self.depth
        group, rank = group[keep], rank[keep]
        self.score[group, rank], self.key[group, rank] = score[keep], key[keep]
        self.count[touched] = np.bincount(np.searchsorted(touched, group), minlength=len(touched))

    def rows(self):
        """(group, score, key) of all that is held."""
        held = np.arange(self.depth) < self.count[:, None]
        return np.repeat(np.arange(len(self.count)), self.count), self.score[held], self.key[held]


def whole_components(vectors) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each vector length: the usable rows' positions and their components, ``floor(256 * x)``, as doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat * SCALE)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    out = []
    for d in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == d)
        part = flat[start[at][:, None] + np.arange(d)]
        fine = np.isfinite(part).all(axis=1)
        out.append((at[fine], part[fine]))
    return out


class Chunk:
    """Anchors of one chunk, in order of length and label."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        number, key, label = (table.column(c).to_numpy() for c in ("anchor", "key", "label"))
        parts = sorted(((m.shape[1], at, m) for at, m in whole_components(table.column("vector"))), key=lambda x: x[0])
        self.blocks, at, taken = [], 0, []  # (length, label or None if mixed, first, matrix)
        for d, rows, m in parts:
            order = np.argsort(label[rows], kind="stable")
            rows, m = rows[order], m[order]
            self.blocks.append((d, at, m))
            taken.append(rows)
            at += len(rows)
        rows = np.concatenate(taken) if taken else np.zeros(0, np.int64)
        self.number, self.key, self.label = number[rows], key[rows], label[rows]


def _blocks(chunk: Chunk, batch, same_label: bool):
    """(first anchor, scores, positions of the candidates) of all blocks in which anchors meet candidates."""
    label = batch.column("label").to_numpy()
    for at, m in whole_components(batch.column("vector")):
        order = np.argsort(label[at], kind="stable")
        at, m = at[order], m[order]
        for d, first, own in chunk.blocks:
            if d != m.shape[1]:
                continue
            if same_label:
                names, where = np.unique(label[at], return_index=True)
                where = np.append(where, len(at))
                mine = chunk.label[first:first + len(own)]
                spans = [(np.searchsorted(mine, x), np.searchsorted(mine, x, "right"), where[i], where[i + 1])
                         for i, x in enumerate(names)]
            else:
                spans = [(0, len(own), 0, len(at))]
            for a0, a1, c0, c1 in spans:
                for a in range(a0, a1, ANCHORS):
                    for c in range(c0, c1, CANDIDATES):
                        b, e = min(a + ANCHORS, a1), min(c + CANDIDATES, c1)
                        yield first + a, packed_scores(own[a:b], m[c:e]), at[c:e]


def _emit(slot: int, chunk: Chunk, best: Best):
    group, score, key = best.rows()
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk.number[group]), pa.array(np.full(len(group), slot, np.int32)), pa.array(key), pa.array(score)],
        ["anchor", "slot", "key", "score"])


OFFERS = "anchor long, slot int, key long, score long"


def _positives(rows: DataFrame, chunk, depth: int) -> DataFrame:
    """Every task's best rows of the anchors' own labels."""
    def run(batches):
        forget()
        own: Chunk = chunk.value
        best = Best(len(own.number), depth)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            for first, score, at in _blocks(own, batch, same_label=True):
                who = slice(first, first + len(score))
                a, c = np.nonzero((score >= best.least()[who, None]) & (own.key[who, None] != key[at]))
                best.offer(first + a, score[a, c], key[at[c]])
        yield _emit(0, own, best)
        trim()

    return rows.mapInArrow(run, OFFERS)


def _negatives(rows: DataFrame, chunk, wanted, depth: int, percent: int) -> DataFrame:
    """Every task's best rows of other labels below the score of each positive (``wanted``: by anchor and slot)."""
    def run(batches):
        forget()
        own: Chunk = chunk.value
        top, known = wanted.value
        floor = -((-percent * top) // 100)
        best = [Best(len(own.number), depth) for _ in range(top.shape[1])]
        for batch in batches:
            if not batch.num_rows:
                continue
            key, label = batch.column("key").to_numpy(), batch.column("label").to_numpy()
            for first, score, at in _blocks(own, batch, same_label=False):
                who = slice(first, first + len(score))
                least = np.stack([np.maximum(floor[who, s], b.least()[who]) for s, b in enumerate(best)], axis=1)
                low = np.where(known[who], least, LIMIT + 1).min(axis=1)
                high = np.where(known[who], top[who], -LIMIT - 1).max(axis=1)
                a, c = np.nonzero((score >= low[:, None]) & (score <= high[:, None])
                                  & (own.label[who, None] != label[at]) & (own.key[who, None] != key[at]))
                found = score[a, c]
                for s, b in enumerate(best):
                    fits = known[first + a, s] & (found <= top[first + a, s]) & (found >= least[a, s])
                    if fits.any():
                        b.offer(first + a[fits], found[fits], key[at[c[fits]]])
        for s, b in enumerate(best):
            yield _emit(s, own, b)
        trim()

    return rows.mapInArrow(run, OFFERS)


def _ranked(offers: DataFrame, depth: int) -> DataFrame:
    """The best of all tasks' rows, per anchor and slot; ``rank`` from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "key")
    return offers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def mine(rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
         depth: int = DEPTH, percent: int = LEAST_PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Hard negatives of each anchor and positive.

    Positives of an anchor: its first ``depth`` other rows of the same label.
    Negatives of a positive: the first ``depth`` rows of other labels whose score
    is at most the positive's and at least ``percent`` per cent of it.  Returns
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``;
    ``is_anchor`` is a condition on the columns of ``rows``.
    """
    spark = rows.sparkSession
    usable = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    named = [F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"),
             F.col(vector).cast("array<double>").alias("vector")]
    anchors = store(usable.filter(is_anchor).select(*named).withColumn("anchor", F.monotonically_increasing_id()),
                    "anchors")
    total, bytes_ = anchors.agg(F.count(F.lit(1)), F.sum(F.size("vector") * 8 + 32)).first()
    chunks = max(1, -(-(bytes_ or 0) * 5 // (4 * chunk_bytes)))
    usable = usable.select(*named)
    dealt = F.pmod(F.xxhash64("anchor"), F.lit(chunks))
    found = None
    for c in range(chunks if total else 0):
        # bounded by chunk_bytes whatever the number of rows
        own = spark.sparkContext.broadcast(Chunk(anchors.filter(dealt == c).toArrow()))
        size = len(own.value.number)
        if not size:
            continue
        positives = store(_ranked(_positives(usable, own, depth), depth).select(
            "anchor", "rank", F.col("key").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        got = positives.select("anchor", "rank", "positive_score").toArrow()  # at most depth rows an anchor
        top, known = np.zeros((size, depth), np.int64), np.zeros((size, depth), bool)
        order = np.argsort(own.value.number)
        at = order[np.searchsorted(own.value.number, got.column("anchor").to_numpy(), sorter=order)]
        slot = got.column("rank").to_numpy() - 1
        top[at, slot], known[at, slot] = got.column("positive_score").to_numpy(), True
        wanted = spark.sparkContext.broadcast((top, known))
        negatives = _ranked(_negatives(usable, own, wanted, depth, percent), depth)
        part = store(positives.join(negatives.withColumnRenamed("rank", "place"), (positives["anchor"] == negatives["anchor"])
                                    & (positives["rank"] == negatives["slot"] + 1))
                     .select(positives["anchor"], "positive_id", "place", F.col("key").alias("negative_id"),
                             "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
        found = part if found is None else found.unionByName(part)
    names = anchors.select("anchor", F.col("key").alias("anchor_id"))
    if found is None:
        found = anchors.filter("false").select("anchor", F.lit(0).cast("long").alias("positive_id"), F.lit(0).alias("place"),
                                               F.lit(0).cast("long").alias("negative_id"),
                                               F.lit(0).cast("long").alias("positive_score"),
                                               F.lit(0).cast("long").alias("negative_score"))
    return found.join(names, "anchor").select("anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id",
                                              "positive_score", "negative_score")
