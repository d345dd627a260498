"""Line dedup: winnowing over line hashes, position joins, extension both ways.

Lines without a word are skipped, the others are hashed.  A *run* is ``least``
successive lines of a document.  Line ``gram``-grams are fingerprinted, and in
every run the smallest gram hash (the rightmost of equals) is selected, so two
equal runs always select the same fingerprint at the same place (winnowing,
Schleimer et al. 2003).  Fingerprints that occur at two positions or more are
joined back to their positions; from there a match is extended both ways, run by
run, as long as the run found there also begins at an earlier position (smaller
doc_id, then row, then line).  Every line of a repeated run is deleted from the
later place; the first place keeps all.  Judged on the input: a run counts as
repeated even if its earlier copy is itself deleted.

With ``long_runs`` fewer lines than ``least`` are a run too if together they have
that many words or bytes (``LONG`` in the registered query), and so are all lines
of a shorter document if they are all lines of an earlier one.

Counts and first positions are aggregated per task before they are shuffled, and
the join that brings positions back is salted, so a line that a third of all
documents share is no hot key.

Edge cases: null text is empty; without ``long_runs`` a document with fewer than
``least`` lines with words keeps all of them; equal documents lose all lines but in the first one;
rows that share a doc_id are ordered by row; null doc_ids come first; lines
without a word stay; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, join_checked, keyed, mix, slices, store

LEAST = 3
GRAM = 2
#: Words, or bytes (for scripts without spaces), from which fewer lines than ``LEAST`` are a run.
LONG = (50, 600)
WHITE = " \t\n\r\x0b\f"
#: Order of positions.
PLACE_COLUMNS = ("doc_id", "row_id", "run")


def line_hashes(lines: list[bytes]) -> np.ndarray:
    """64-bit hashes of lines."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in lines), "<u8")


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` successive values."""
    size = max(len(hashes) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = mix(out ^ hashes[k:k + size]) + np.uint64(k + 1)
    return out


def selected(hashes: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every run: hash and place of its fingerprint (smallest gram, rightmost of equals)."""
    g = grams(hashes, gram)
    window = least - gram + 1
    runs = max(len(g) - window + 1, 0)
    if not runs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, window)[:, ::-1]
    place = window - 1 - view.argmin(axis=1) + np.arange(runs)
    return g[place], place


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def short_runs(lines: list[bytes], hashes: np.ndarray, least: int, long_runs: tuple[int, int]):
    """``(places, width, hashes)`` of the long runs under ``least`` lines, and of a whole text under ``least`` lines."""
    size = [np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
            for x in ([len(x.split()) for x in lines], [len(x) for x in lines])]
    for width in range(1, min(least - 1, len(lines)) + 1):
        run = grams(hashes, width)
        at = np.flatnonzero(np.any([x[width:] - x[:-width] >= limit for x, limit in zip(size, long_runs)], axis=0))
        yield at, width, mix(run[at] ^ np.uint64(2 * width))
        if width == len(lines):
            yield np.zeros(1, np.int64), width, mix(run ^ np.uint64(2 * width + 1))


def at_two_places(runs: DataFrame, column: str) -> DataFrame:
    """Runs whose ``column`` has another position too, with the ``first`` of its positions."""
    place = F.struct(*PLACE_COLUMNS)
    return grouped(runs, [column], ["row_id", "run"], {"first": (F.min(place), F.min), "last": (F.max(place), F.max)},
                   "first < last").drop("last")


def repeated_runs(rows: DataFrame, least: int, gram: int, long_runs: tuple[int, int] | None = None) -> DataFrame:
    """``row_id, run, width`` of every run that also begins at an earlier position."""
    def scan(batches):
        for b in slices(batches):
            out: dict[str, list] = {"row_id": [], "doc_id": [], "run": [], "width": [], "fingerprint": [], "content": []}
            for r, d, t in zip(b.column("row_id").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                lines = [x.encode() for x in t.as_py().split("\n") if x.strip(WHITE)]
                hashes = line_hashes(lines)
                mark, _ = selected(hashes, least, gram)
                found = [(np.arange(len(mark)), least, mark, grams(hashes, least))]
                if long_runs:
                    found += [(at, width, h, h) for at, width, h in short_runs(lines, hashes, least, long_runs)]
                for at, width, mark, content in found:
                    n = len(at)
                    if n:
                        out["row_id"].append(np.full(n, r))
                        out["doc_id"] += [d] * n
                        out["run"].append(at)
                        out["width"].append(np.full(n, width))
                        out["fingerprint"].append(mark.view(np.int64))
                        out["content"].append(content.view(np.int64))
            cat = lambda k: pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [cat("row_id"), pa.array(out["doc_id"], pa.int64()), cat("run"), cat("width"), cat("fingerprint"), cat("content")],
                ["row_id", "doc_id", "run", "width", "fingerprint", "content"])

    runs = store(rows.mapInArrow(scan, "row_id long, doc_id long, run long, width long, fingerprint long, content long"), "runs")
    candidates = store(at_two_places(runs, "fingerprint").drop("first", "fingerprint"), "candidates")
    return at_two_places(candidates, "content").filter(F.struct(*PLACE_COLUMNS) > F.col("first")).select("row_id", "run", "width")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST,
                gram: int = GRAM, long_runs: tuple[int, int] | None = None) -> DataFrame:
    """``doc_id, text`` without later repeated runs, ``n_lines``, ``n_deleted`` of every row."""
    rows = keyed(docs, key, text)
    runs = store(repeated_runs(rows, least, gram, long_runs).groupBy("row_id", "width")
                 .agg(F.sort_array(F.collect_set("run")).alias("runs"))
                 .groupBy("row_id").agg(F.collect_list(F.struct("width", "runs")).alias("runs")), "repeated")  # of one document
    joined = join_checked(rows, runs, "row_id", "left", 500)

    def cut(batches):
        for b in slices(batches):
            out: dict[str, list] = {"doc_id": b.column("doc_id").to_pylist(), "text": [], "n_lines": [], "n_deleted": []}
            for t, found in zip(b.column("text"), b.column("runs").to_pylist()):
                lines = t.as_py().split("\n")
                gone = np.zeros(len(lines), bool)
                if found:
                    at = np.array([i for i, x in enumerate(lines) if x.strip(WHITE)])
                    for kind in found:
                        for k in range(kind["width"]):
                            gone[at[np.array(kind["runs"]) + k]] = True
                out["text"].append("\n".join(x for x, g in zip(lines, gone) if not g))
                out["n_lines"].append(len(lines))
                out["n_deleted"].append(int(gone.sum()))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_deleted", pa.int64())]))

    return joined.select("doc_id", "text", "runs").mapInArrow(
        cut, "doc_id long, text string, n_lines long, n_deleted long")
