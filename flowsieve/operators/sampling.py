"""Chunks, heads, capped stratified samples, interleaving, splits and file picks.

Every "first k" or running-number operator takes an explicit, unique order key
(CSV has no row index).  Running numbers go through ``scan``: no key, file or class
is numbered inside a single task.  Firsts go through ``selection``: rows are cut by
a histogram of their order before any are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import (CHUNK_ROWS, TEST_MAX_ROWS_PER_CLASS, TEST_ROWS_PER_FILE,
                        TUNING_FILES, TUNING_ROWS_PER_FILE)
from ..functions import permute
from . import scan, selection

#: Rows up to which a stored table of keys or weights is broadcast.
SMALL_ROWS = 1_000_000

# Seeded permutation of integral file ids: (id * A + seed * B) mod P, P prime.
_PICK_A, _PICK_B, _PICK_P = 7919, 104729, 1000003


def pick_key(file_col: Column, seed: int) -> Column:
    """Position of a file in the seeded order (an own permutation, not Python's random)."""
    return F.pmod(F.pmod(file_col.cast("long"), F.lit(_PICK_P)) * _PICK_A + seed * _PICK_B, F.lit(_PICK_P))


def pick_files(df: DataFrame, file_col: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` files in seeded order (one row per picked file, ``pick_rank`` 1..n).

    The distinct file list is one row per file; ranking it in one window is
    bounded by the number of files, not by rows.
    """
    files = df.select(F.col(file_col)).distinct()
    w = Window.orderBy(pick_key(F.col(file_col), seed), F.col(file_col))
    return files.select(file_col, F.row_number().over(w).alias("pick_rank")).where(F.col("pick_rank") <= n)


def chunk_assign(df: DataFrame, file_col: str, order_col: str, chunksize: int = CHUNK_ROWS) -> DataFrame:
    """Cut each file into chunks of ``chunksize`` rows in ``order_col`` order."""
    out = scan.row_number(df, [file_col], [order_col], "__rn")
    return out.withColumn("chunk_id", F.floor((F.col("__rn") - 1) / chunksize).cast("long")).drop("__rn")


def chunk_places(df: DataFrame, file_col: str, order_col: str, chunksize: int = CHUNK_ROWS) -> DataFrame:
    """``chunk_assign`` with ``chunk_index``, the row's number in its chunk from 0, and ``chunk_rows``, the chunk's size."""
    out = scan.row_number(df, [file_col], [order_col], "__rn", totals=True)
    at, chunk = F.col("__rn") - 1, F.lit(chunksize).cast("long")
    out = out.withColumn("chunk_id", F.expr(f"(__rn - 1) div {chunksize}")).withColumn("chunk_index", at % chunk)
    return out.withColumn("chunk_rows", F.least(chunk, F.col("__rn_total") - F.col("chunk_id") * chunk)).drop("__rn", "__rn_total")


def head_per_file(df: DataFrame, file_col: str, order_col: str, k: int) -> DataFrame:
    """First ``k`` rows of every file (``rn`` is the 1-based position); rows are cut before they are ranked."""
    return selection.first_k(df, [file_col], [order_col], k, "rn")


def stratified_cap_sample(df: DataFrame, file_col: str, order_col: str, label_col: str,
                          rows_per_file: int = TEST_ROWS_PER_FILE,
                          max_rows_per_class: int = TEST_MAX_ROWS_PER_CLASS,
                          classes: list[str] | None = None) -> DataFrame:
    """From the first ``rows_per_file`` rows of each file, at most ``max_rows_per_class`` per class.

    Files are visited in ``file_col`` order and rows in ``order_col`` order, so
    a class fills its quota from the earliest files first.  Rows whose label is
    null or outside ``classes`` are dropped before counting.
    """
    head = head_per_file(df, file_col, order_col, rows_per_file).drop("rn")
    head = head.where(F.col(label_col).isNotNull())
    if classes is not None:
        head = head.where(F.col(label_col).isin(*classes))
    return selection.first_k(head, [label_col], [file_col, order_col], max_rows_per_class, "__class_rn").drop("__class_rn")


def round_robin_order(df: DataFrame, file_col: str, chunk_col: str) -> DataFrame:
    """Interleave: chunk 0 of every file, then chunk 1 of every file, ...

    Ranks the distinct (chunk, file) pairs -- one row per chunk -- with the
    distributed running number and joins the sequence number back.
    """
    pairs = df.select(chunk_col, file_col).distinct()
    seq = scan.row_number(pairs, [], [chunk_col, file_col], "__seq")
    seq = seq.select(chunk_col, file_col, (F.col("__seq") - 1).cast("long").alias("seq"))
    return df.join(seq, [chunk_col, file_col], "inner")


def chunk_shuffle(chunks: DataFrame, rotation: str, seed: int = 42, name: str = "pos") -> DataFrame:
    """Seeded shuffle inside each chunk (``chunk_places``): the row's position from 1, without a sort.

    ``rotation`` names a whole number that, with ``seed``, names the permutation.
    """
    where = permute.place(F.col("chunk_index"), F.col("chunk_rows"), F.col(rotation).cast("long") + F.lit(seed))
    return chunks.withColumn(name, where + 1).drop("chunk_index", "chunk_rows")


def ordered_split(df: DataFrame, order_col: str, train_frac: float = 0.8,
                  calib_frac: float = 0.9) -> DataFrame:
    """Unshuffled splits by position: first ``floor(train_frac*n)`` rows train, rest validate;
    rows past ``floor(calib_frac*n)`` are held out for calibration."""
    numbered = scan.row_number(df, [], [order_col], "__rn", totals=True)
    n = F.col("__rn_total")
    return (numbered
            .withColumn("tune_part", F.when(F.col("__rn") <= F.floor(n * train_frac), "train").otherwise("val"))
            .withColumn("calib_part", F.when(F.col("__rn") <= F.floor(n * calib_frac), "test")
                        .otherwise("calibration"))
            .drop("__rn", "__rn_total"))


def holdout_split(df: DataFrame, test_keys: DataFrame, key: str) -> DataFrame:
    """Training rows = all rows minus the test keys (left anti join on the row key)."""
    return df.join(test_keys.select(key).distinct(), key, "left_anti")


def holdout_counted(df: DataFrame, test_keys: DataFrame, key: str) -> DataFrame:
    """``holdout_split`` for keys that are stored: few enough, they are broadcast and no row of ``df`` moves."""
    return join_counted(df, test_keys.select(key), [key], "left_anti")


def join_counted(df: DataFrame, side: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``df`` joined with a stored table: broadcast up to ``SMALL_ROWS`` counted rows, else joined by shuffle."""
    return df.join(F.broadcast(side) if side.count() <= SMALL_ROWS else side, keys, how)


def copies(sample: DataFrame, key: str) -> DataFrame:
    """Keys of a sample with how often it holds each (``copies``)."""
    return sample.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))


def rows_of(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The whole rows of a sample that was drawn from narrow ones: rows of one key are equal, each comes as often as ``copies`` says."""
    found = join_counted(df, keys.select(key, "copies"), [key], "inner").dropDuplicates([key])
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return found.withColumn("__copy", times).select(*df.columns)


def tuning_sample(df: DataFrame, file_col: str, order_col: str, n_files: int = TUNING_FILES,
                  rows_per_file: int = TUNING_ROWS_PER_FILE, seed: int = 42) -> DataFrame:
    """First chunk of ``n_files`` seeded files."""
    picked = pick_files(df, file_col, n_files, seed).select(file_col)
    chosen = df.join(picked, file_col, "left_semi")
    return head_per_file(chosen, file_col, order_col, rows_per_file).drop("rn")


def balanced_weights(df: DataFrame, chunk_col: str, label_col: str, out: str = "weight") -> DataFrame:
    """Per chunk: ``n / (classes present * rows of the class)``.

    ``count(DISTINCT) OVER`` is not allowed, so class counts per chunk are
    aggregated first (one row per chunk and class) and joined back.
    """
    return df.join(class_weights(df, chunk_col, label_col, out), [chunk_col, label_col], "left")


def class_weights(df: DataFrame, chunk_col: str, label_col: str, out: str = "weight") -> DataFrame:
    """The weights of ``balanced_weights``: one row per chunk and class."""
    per_class = df.groupBy(chunk_col, label_col).agg(F.count(F.lit(1)).alias("__nc"))
    w = Window.partitionBy(chunk_col)
    return per_class.select(
        chunk_col, label_col,
        (F.sum("__nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("__nc"))).alias(out))


def file_manifest(df: DataFrame, file_col: str) -> DataFrame:
    """Rows per file and total rows (the window runs over one row per file)."""
    per_file = df.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_rows"))
    return per_file.withColumn("total_rows", F.sum("n_rows").over(Window.partitionBy()))
