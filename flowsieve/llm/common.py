"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsieve.session import scratch_path, shuffle_partitions

#: A side of a join is broadcast only when its stored size is at most this.
BROADCAST_BYTES = 48 << 20
#: Text handled at once inside a task.
SLICE_BYTES = 4 << 20
#: Column of ``numbered``; underscores follow while the input has a column of that name.
ROW = "_row_id"


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(docs: DataFrame):
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def store(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation
    with other partition numbers.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def odd_keys(docs: DataFrame, key: str) -> bool:
    """Whether ``key`` is null or repeated in some row."""
    return bool(docs.select(F.col(key).cast("long").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
                .filter("n > 1 or k is null").limit(1).count())


def numbered(docs: DataFrame, key: str, text: str, nulls_first: bool) -> tuple[DataFrame, str]:
    """``docs`` with a unique long (named as told) that orders rows as ``key`` does; whole rows are stored if keys are odd."""
    name = free_name(docs, ROW)
    if not odd_keys(docs, key):
        return docs.withColumn(name, F.col(key).cast("long")), name
    value = F.col(key).cast("long")
    order = [value.asc_nulls_first() if nulls_first else value.asc_nulls_last(), F.xxhash64(text)]
    return store(docs.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def keyed(docs: DataFrame, key: str, text: str, extra: dict | None = None) -> DataFrame:
    """``row_id`` (unique long), ``doc_id``, ``text`` (null text is empty) and ``extra`` columns.

    ``row_id`` is the key itself when it is a unique integer without nulls.
    Otherwise (nulls, repeated rows) the rows are stored once and numbered in
    ascending key order, nulls first, so that every row keeps an identity of its
    own and ``row_id`` orders rows as the key does.  Other columns of ``docs`` are
    left out, so their names cannot clash with those of an operator.
    """
    cols = [F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    cols += [c.alias(k) for k, c in (extra or {}).items()]
    rows = docs.select(*cols)
    if not key.startswith(ROW) and odd_keys(docs, key):
        order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
        rows = store(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("row_id", F.monotonically_increasing_id()), "rows")
    else:
        rows = rows.withColumn("row_id", F.col("doc_id"))
    return rows.select("row_id", "doc_id", "text", *(extra or {}))


def join_checked(big: DataFrame, small: DataFrame, on: str, how: str, row_bytes: int,
                 rows: int | None = None, more: int = 0) -> DataFrame:
    """Join that broadcasts ``small`` only if its rows (counted) times ``row_bytes`` (and ``more`` bytes) fit the bound.

    ``small`` must be a stored table, so the count is cheap.  Beyond the bound
    both sides are shuffled and the smaller side is hashed per partition.
    """
    n = small.count() if rows is None else rows
    if n * row_bytes + more <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("shuffle_hash"), on, how)


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the keys in ``gone`` (one column), columns as they were."""
    name = free_name(docs, "_gone")
    gone = store(gone.toDF(name).filter(F.col(name).isNotNull()).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone.hint("shuffle_hash")
    return docs.join(side, F.col(key).cast("long") == F.col(name), "left_anti")


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Arrow record batches cut so that ``column`` has at most ``limit`` bytes (or one row) each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
        done = 0
        ends = np.cumsum(size)
        while done < batch.num_rows:
            base = ends[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(done, stop - done)
            done = stop


@contextmanager
def batches_of(spark, rows: int):
    """Jobs started here hand Python at most so many rows at once: a batch is held by the executor and by its worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply and shift), in place where possible."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i+1]]``; empty segments give 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array as one uint8 array, and the n + 1 offsets into it."""
    array = array.cast(pa.large_binary())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def strings(array) -> list[str]:
    """A string array without nulls as Python strings; ``to_pylist`` makes a scalar of each first."""
    return array.to_numpy(zero_copy_only=False).tolist()


class Words:
    """Words (runs of anything but the six ASCII white-space characters) of a slice of texts.

    ``codes`` are positions in ``distinct`` (an Arrow string array), word by
    word; ``offsets`` are the n + 1 borders between documents.
    """

    def __init__(self, texts):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat = lists.flatten()
        # leading or trailing white space yields empty words
        full = pc.not_equal(flat, "")
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets -= offsets[0]
        if not pc.all(full).as_py() and len(flat):
            keep = full.to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
            flat = flat.filter(full)
        coded = flat.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary
        self.offsets = offsets.astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def document_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def within(self, width: int) -> np.ndarray:
        """Mask of the words at which a window of ``width`` words of one document starts."""
        n = len(self.codes)
        end = np.repeat(self.offsets[1:], np.diff(self.offsets))
        return np.arange(n) + width <= end


_HELD: dict = {}


def worker_cache(name, make):
    """What a Python worker keeps between tasks: one operator's at a time, as workers serve all stages."""
    if name not in _HELD:
        forget()
        _HELD[name] = make()
    return _HELD[name]


def trim() -> None:
    """Give freed memory back to the system: an idle Python worker counts against its executor too."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def forget() -> None:
    """Drop what an operator with a cache has left in this Python worker; for those without one."""
    _HELD.clear()
    trim()


class TwoAges:
    """Cache of at most two generations of ``capacity`` entries; the older one is dropped whole."""

    def __init__(self, capacity: int):
        self.capacity, self.young, self.old = capacity, {}, {}

    def lookup(self, keys: list, make) -> list:
        """Values for ``keys`` in order; ``make(list of unknown keys)`` gives theirs."""
        young, old = self.young, self.old
        found = [young.get(k) for k in keys]
        absent = [i for i, v in enumerate(found) if v is None]
        unknown = []
        for i in absent:
            v = old.get(keys[i])
            if v is None:
                unknown.append(i)
            else:
                found[i] = young[keys[i]] = v
        if unknown:
            for i, v in zip(unknown, make([keys[i] for i in unknown])):
                found[i] = young[keys[i]] = v
        if len(young) > self.capacity:
            self.old, self.young = young, {}
        return found


class ByteCache:
    """Cache of two generations bounded by bytes: an entry counts about 200, and 4 for each letter of its key."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.young, self.old = capacity, 0, {}, {}

    def lookup(self, keys: list, make) -> list:
        """Values (never None) for ``keys`` in order; ``make(list of unknown keys)`` gives theirs."""
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        moved, unknown = [], []
        for i in [i for i, v in enumerate(found) if v is None]:
            v = found[i] = old.get(keys[i])
            (unknown if v is None else moved).append(i)
        for i in moved:
            young[keys[i]] = found[i]
        fresh = [keys[i] for i in unknown]
        if unknown:
            for i, k, v in zip(unknown, fresh, make(fresh)):
                found[i] = young[k] = v
        fresh += [keys[i] for i in moved]
        self.held += 200 * len(fresh) + 4 * sum(map(len, fresh))
        if self.held > self.capacity:
            self.old, self.young, self.held = young, {}, 0
        return found


def grouped(rows: DataFrame, keys: list[str], spread: list[str], aggs: dict, keep: str | None = None) -> DataFrame:
    """Rows with values of their whole group, without a task that holds a whole group.

    ``aggs``: name -> (aggregate of rows, aggregate of those aggregates).  Rows are
    salted by ``spread``, aggregated per (keys, salt), combined over the salts and
    joined back on (keys, salt).  ``keep`` filters groups by the new values.
    """
    salts = max(8, shuffle_partitions(rows.sparkSession))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    part = salted.groupBy(*keys, "_salt").agg(*[own.alias(f"_{k}") for k, (own, _) in aggs.items()])
    one = Window.partitionBy(*keys)  # at most one row per salt
    whole = part.select(*keys, "_salt", *[both(f"_{k}").over(one).alias(k) for k, (_, both) in aggs.items()])
    if keep:
        whole = whole.filter(keep)
    return salted.join(whole, [*keys, "_salt"]).drop("_salt")
