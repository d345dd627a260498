"""Packing token sequences as a cutting-stock problem.

Documents longer than a sequence are cut into full pieces and a remainder, and a
remainder longer than half a sequence into a half and the rest: pieces just over
half a sequence would leave room that nothing fills.  The pieces' lengths, rounded up to classes of ``step`` ids, form a histogram of at
most ``capacity / step`` rows whatever the corpus size.  On that histogram a
linear program chooses how often each pattern (a multiset of classes that fits
a sequence) is used: column generation starts from one-class patterns, an
unbounded-knapsack dynamic program over the dual prices finds the next pattern,
and stops when the bound of Farley (1990) is within ``gap`` of the solution.
The solution is rounded down, then topped up pattern by pattern in order of the
fractions, and the few pieces left are placed best-fit.  The plan has a few
thousand rows.  Pieces are ranked within their class by a distributed numbering
(counts per class and slice, then a window per class and slice, so a length
that a third of all pieces share is spread over all slices), and a rank finds
its sequence by binary search in the plan.

Edge cases: null text is empty and packs as its end id alone; a null or repeated
doc_id keeps all its rows; texts longer than a sequence are cut, never dropped;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsieve.session import shuffle_partitions

from .common import batches_of, keyed, store
from .tokens import END_ID, default_vocabulary, tokenise

CAPACITY = 2048
STEP = 4
GAP = 5e-4
#: Texts that travel to Python at once: a whole part of a table (25 MB of text) would otherwise be one batch.
BATCH_ROWS = 500


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: most valuable multiset of ``sizes`` (ascending) within ``capacity``."""
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    useful = np.flatnonzero(prices > 1e-12)
    size, price = sizes[useful], prices[useful]
    fits = np.searchsorted(size, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = fits[c]
        value[c], pick[c] = value[c - 1], -1
        if k:
            got = value[c - size[:k]] + price[:k]
            j = int(got.argmax())
            if got[j] > value[c] + 1e-15:
                value[c], pick[c] = got[j], j
    pattern = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[useful[pick[c]]] += 1
            c -= int(size[pick[c]])
    return float(value[capacity]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP,
                   rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: patterns (one per row) and how often each is used (fractions)."""
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    use = demand / (capacity // sizes)
    for _ in range(rounds):
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        worth, column = best_pattern(prices, sizes, capacity)
        if worth <= 1 + 1e-9 or use.sum() <= (prices @ demand) / worth * (1 + gap):
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        use = use - ratio[out] * step
        use[out] = ratio[out]
        np.maximum(use, 0, out=use)
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        patterns[out] = column
    return patterns.astype(np.int64), use


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                   gap: float = GAP) -> list[tuple[int, dict[int, int]]]:
    """Integer plan that places every piece: (times, {class position: count}), exact in every class."""
    patterns, use = solve_patterns(sizes, demand, capacity, gap)
    left = demand.astype(np.int64).copy()
    plan = []
    times = np.floor(use + 1e-9).astype(np.int64)
    order = np.argsort(-(use - times), kind="stable")

    def take(p: int, n: int) -> None:
        nonlocal left
        column = patterns[p]
        need = column > 0
        n = min(n, int((left[need] // column[need]).min())) if need.any() else 0
        if n > 0:
            left = left - n * column
            plan.append((n, {int(c): int(column[c]) for c in np.flatnonzero(need)}))

    for p in np.argsort(-times, kind="stable"):
        take(int(p), int(times[p]))
    for p in order:
        take(int(p), 1)
    # best fit for what is left: at most a few pieces for each pattern
    room = np.zeros(0, np.int64)
    bins: list[dict[int, int]] = []
    for c in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[c])):
            fits = np.flatnonzero(room >= sizes[c])
            if len(fits):
                b = int(fits[room[fits].argmin()])
            else:
                b, bins = len(bins), [*bins, {}]
                room = np.append(room, capacity)
            bins[b][int(c)] = bins[b].get(int(c), 0) + 1
            room[b] -= sizes[c]
    return plan + [(1, b) for b in bins]


@dataclass
class Plan:
    """Slots of each class, in rank order: first rank, pieces per sequence, first sequence."""
    classes: np.ndarray
    borders: np.ndarray
    first_rank: np.ndarray
    per_sequence: np.ndarray
    first_sequence: np.ndarray
    sequences: int

    def sequence(self, of_class: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.classes, of_class)
        out = np.empty(len(rank), np.int64)
        for k in np.unique(at):
            mine = at == k
            s, e = self.borders[k], self.borders[k + 1]
            slot = s + np.searchsorted(self.first_rank[s:e], rank[mine], "right") - 1
            out[mine] = self.first_sequence[slot] + (rank[mine] - self.first_rank[slot]) // self.per_sequence[slot]
        return out


def make_plan(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> Plan:
    slots: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    placed = np.zeros(len(sizes), np.int64)
    sequences = 0
    for times, pattern in whole_patterns(sizes, demand, capacity, gap):
        for c, n in pattern.items():
            slots[c].append((int(placed[c]), n, sequences))
            placed[c] += times * n
        sequences += times
    flat = np.array([x for s in slots for x in s], np.int64).reshape(-1, 3)
    return Plan(sizes, np.cumsum([0] + [len(s) for s in slots]), flat[:, 0], flat[:, 1], flat[:, 2], sequences)


def ranked(rows: DataFrame, group: str, key: str, slices: int) -> DataFrame:
    """``rank`` (from 0) of every row within its group, without a task that holds a whole group."""
    cut = rows.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)))
    before = (cut.groupBy(group, "slice").agg(F.count(F.lit(1)).alias("n"))
              .select(group, "slice", (F.sum("n").over(
                  Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).alias("before")))
    inner = cut.withColumn("within", F.row_number().over(Window.partitionBy(group, "slice").orderBy(key)) - 1)
    return (inner.join(before, [group, "slice"])
            .withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("within")).drop("slice", "within", "before"))


def pack(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY, step: int = STEP, end_id: int = END_ID, gap: float = GAP) -> DataFrame:
    """Packed pieces: ``piece_id, doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` holds the piece's token ids (``tokens.unpack_ids``); the pieces of a
    sequence laid end to end by ``offset`` are the training sequence, padded to
    ``capacity``.
    """
    spark = docs.sparkSession
    ids = tokenise(keyed(docs, key, text), vocabulary or default_vocabulary(), end_id, (capacity, capacity // 2))
    with batches_of(spark, BATCH_ROWS):
        pieces = store(ids.withColumn("piece_id", F.monotonically_increasing_id()).drop("row_id"), "pieces", "uncompressed")
    sized = pieces.select("piece_id", "length", (F.floor((F.col("length") + step - 1) / step)).alias("units"))
    histogram = sized.groupBy("units").agg(F.count(F.lit(1)).alias("n")).orderBy("units").collect()  # <= capacity/step
    sizes = np.array([r["units"] for r in histogram], np.int64)
    demand = np.array([r["n"] for r in histogram], np.int64)
    plan = make_plan(sizes, demand, capacity // step, gap)

    def place(batches):
        for b in batches:
            got = plan.sequence(b.column("units").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column("piece_id"), b.column("length"), pa.array(got, pa.int64())],
                ["piece_id", "length", "sequence_id"])

    placed = ranked(sized, "units", "piece_id", shuffle_partitions(spark)).select(
        "piece_id", "length", "units", "rank").mapInArrow(place, "piece_id long, length long, sequence_id long")
    # a sequence has at most ``capacity`` pieces
    along = Window.partitionBy("sequence_id").orderBy("piece_id")
    placed = placed.select("piece_id", "sequence_id",
                           (F.sum("length").over(along) - F.col("length")).alias("offset"))
    return pieces.join(placed, "piece_id").select(
        "piece_id", "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def with_crc(pieces: DataFrame) -> DataFrame:
    """``ids_crc32`` of the packed ids in place of ``ids``."""
    from .tokens import crc_of_ids, unpack_ids

    kept = [c for c in pieces.columns if c != "ids"]

    def run(batches):
        for b in batches:
            crc = pa.array([crc_of_ids(unpack_ids(x.as_py())) for x in b.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), crc], [*kept, "ids_crc32"])

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes if c != "ids")
    return pieces.mapInArrow(run, f"{schema}, ids_crc32 long")
