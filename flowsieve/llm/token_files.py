"""Token-id output: frequency-ranked ids, byte-aligned, control bytes apart from data bytes.

File format.  A folder with two Parquet tables (Spark's committer makes the
files appear whole, also when executors are lost):

* ``ranks``: ``rank, id, n`` - ids by falling corpus frequency (ties: smaller id
  first), at most one row per vocabulary entry;
* ``blocks``: ``shard, block, first_token, n_tokens, rows, docs, lengths, control,
  data`` - shards and blocks follow (doc_id, row) order; ``first_token`` counts
  within the shard.  ``rows``/``docs``/``lengths`` are little-endian 64-bit
  integers, one per document (a null doc_id has a zero bit in ``known``).  Every id is stored as its rank in 1 to 4
  bytes (little-endian) in ``data``; ``control`` has two bits per id (bytes - 1),
  four ids to a byte, lowest bits first.  Frequent ids take one byte.

Decoding looks up 256 x 4 lengths by control byte, turns them into offsets by a
cumulative sum and gathers the bytes with numpy; no loop over ids.

Edge cases: null text is an empty text (one id, the end id); a null doc_id sorts
first and stays null; rows that share a doc_id all appear, in a fixed order; an
empty table gives empty files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, store
from .tokens import END_ID, default_vocabulary, tokenise, unpack_ids

#: Ids after which a block is closed (a block holds whole documents).
BLOCK_IDS = 1 << 18
#: Ids that a task counts at once.
COUNT_IDS = 1 << 20

#: Bytes per id by control byte: 256 x 4.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[:len(ranks)] = size - 1
    control = code[::4] | code[1::4] << np.uint8(2) | code[2::4] << np.uint8(4) | code[3::4] << np.uint8(6)
    used = np.arange(4) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Inverse of ``encode_ranks`` by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)))
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def id_counts(tokens: DataFrame) -> DataFrame:
    """``id, n`` over all documents; each task sends one row per id it has seen."""
    def count(batches):
        total = np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def added():
            c = np.bincount(np.concatenate(held), minlength=len(total))
            c[:len(total)] += total
            return c

        for batch in batches:
            for blob in batch.column("ids"):
                held.append(unpack_ids(blob.as_py()))
                size += len(held[-1])
                if size >= COUNT_IDS:  # a count has a number for each id of the vocabulary, however short the text
                    total = added()
                    held, size = [], 0
        if held:
            total = added()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCK_SCHEMA = ("shard long, block long, first_token long, n_tokens long, rows binary, docs binary, known binary, "
                "lengths binary, control binary, data binary")


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, key: str = "doc_id",
                      text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text and write the files in ascending ``key`` order."""
    spark = docs.sparkSession
    tokens = store(tokenise(keyed(docs, key, text), vocabulary or default_vocabulary(), end_id)
                   .select("row_id", "doc_id", "length", "ids"), "tokens", "uncompressed")
    counted = id_counts(tokens).collect()  # at most one row per vocabulary entry
    order = sorted(((-r["n"], r["id"]) for r in counted))
    by_rank = np.array([i for _, i in order], np.int64)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame([(k, int(i), -n) for k, (n, i) in enumerate(order)], "rank long, id long, n long") \
        .coalesce(1).write.parquet(f"{path}/ranks")

    def blocks(batches):
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal block, first
            ids = np.concatenate([h[2] for h in held])
            control, data = encode_ranks(rank_of[ids])
            row = {"shard": shard, "block": block, "first_token": first, "n_tokens": len(ids),
                   "rows": np.array([h[0] for h in held], "<i8").tobytes(),
                   "docs": np.array([h[1] or 0 for h in held], "<i8").tobytes(),
                   "known": np.packbits([h[1] is not None for h in held]).tobytes(),
                   "lengths": np.array([len(h[2]) for h in held], "<i8").tobytes(),
                   "control": control, "data": data}
            block, first = block + 1, first + len(ids)
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for r, d, blob in zip(batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist(),
                                  batch.column("ids")):
                held.append((r, d, unpack_ids(blob.as_py())))
                size += len(held[-1][2])
                if size >= block_ids:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    (tokens.select("row_id", "doc_id", "ids")
     .repartitionByRange(F.col("doc_id").asc_nulls_first(), "row_id")
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row_id")
     .mapInArrow(blocks, BLOCK_SCHEMA)
     .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, doc_id, start, n_tokens, ids`` (little-endian 32-bit) per document, from the files alone."""
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # one row per shard; shards are the tasks of the writing stage
    before, total = {}, 0
    for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        before[r["shard"]], total = total, total + r["n"]

    def decode(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids = by_rank[decode_ranks(b["control"], b["data"], b["n_tokens"])]
                length = np.frombuffer(b["lengths"], "<i8")
                end = np.cumsum(length)
                begin = end - length
                docs = np.frombuffer(b["docs"], "<i8")
                known = np.unpackbits(np.frombuffer(b["known"], np.uint8))[:len(docs)].astype(bool)
                yield pa.RecordBatch.from_pydict({
                    "row_id": pa.array(np.frombuffer(b["rows"], "<i8"), pa.int64()),
                    "doc_id": pa.array(docs, pa.int64(), mask=~known),
                    "start": pa.array(begin + before[b["shard"]] + b["first_token"], pa.int64()),
                    "n_tokens": pa.array(length, pa.int64()),
                    "ids": pa.array([ids[s:e].tobytes() for s, e in zip(begin, end)], pa.binary())})

    return blocks.mapInArrow(decode, "row_id long, doc_id long, start long, n_tokens long, ids binary")
