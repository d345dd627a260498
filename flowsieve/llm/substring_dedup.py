"""Substring dedup by bucket-pointer refinement over sampled suffixes.

Every byte covered by a ``length``-byte string that also starts in an earlier
document (smaller doc_id) is removed.  Suffix buckets are pairs of bucket
identifiers of shorter strings at later offsets: the bucket of 2q bytes at i is
named by the buckets of q bytes at i and at i + q, so identifiers of one round
are reused by the next until ``length`` bytes are told apart.

A shuffle of every suffix would move many times the corpus, so only sampled
suffixes are shuffled:

1. Initial buckets.  Identifiers of all 16-grams (hashes, by doubling).  Of the
   grams inside a ``length``-byte string the least is its *anchor*: equal strings
   have equal anchors.  Successive strings with one anchor form a stretch (16 on
   average); a stretch sends its anchor's identifier and one identifier of its
   whole content, made of its first and last string's.
2. First refinement, by (anchor, content).  Stretches of equal content are
   duplicates as a whole: those of later documents are removed.  Copies within
   a task are settled there and not sent to their anchor's bucket, so a text
   that a third of all documents share is one row per task.
3. Second refinement, only in anchor buckets with several contents (edges of
   edits and of shared passages), and only for the first document of each
   content, and of these only where 16 bytes beside the anchor's gram come back in
   another document: a string of 47 bytes or more reaches as far to one side.  The
   stretches' bytes are fetched and their strings refined exactly:
   8-byte buckets, then 16, 32 and ``length`` bytes by ranks of bucket pairs.  A
   bucket with more than ``large`` stretches is split into its strings instead,
   which are grouped with salt.
4. The removed strings are merged into spans per document and cut out.

Stage 2 names contents by 64-bit hashes within one anchor bucket; stage 3
compares bytes.

Edge cases: null text is empty; a document shorter than ``length`` keeps all;
rows that share a doc_id are ordered by row, so the later of equal rows is
removed whole; null doc_ids come first; repeats within one document stay; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, join_checked, keyed, mix, slices, store, utf8

LENGTH = 50
GRAM = 16
LARGE = 20_000
#: Stretches refined at once in a task.
BLOCK = 4_000
#: Text sampled at once: each byte takes some 150 in a task, and a cache holds this much.
SAMPLE_BYTES = 512 << 10
#: Rows of one anchor bucket looked through for shared sides; a larger one goes on whole.
HELD = 1_000_000
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Low bits of a gram's identifier that give way to its place, so that the least gram tells where it is.
_AT = np.uint64(20)
_AT_MASK = np.uint64((1 << 20) - 1)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Identifier of two neighbouring buckets."""
    return mix(left * np.uint64(3) + (right ^ (right >> np.uint64(7))) * _PAIR)


def identifiers(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash identifiers of the 16-grams and of the ``length``-byte strings at every place."""
    now, size = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[raw], 1
    grams = now
    while size * 2 <= length:
        now, size = _join(now[:-size], now[size:]), size * 2
        grams = now if size == GRAM else grams
    n = max(len(raw) - length + 1, 0)
    return grams, now[:n] if size == length else _join(now[:n], now[length - size:length - size + n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[:len(values) - (width - size)], values[width - size:])


def sides(grams: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """16 bits of the 16 bytes before and after the gram ``at``, for strings that start in ``start`` to ``end``; 0 for a side not reached.

    A string that starts 16 bytes or more before the gram reaches those before it, any other those after it.
    """
    before = np.maximum(grams[np.maximum(at - GRAM, 0)] & np.uint64(0xFFFF), np.uint64(1)).astype(np.int64)
    after = np.maximum(grams[np.minimum(at + GRAM, len(grams) - 1)] & np.uint64(0xFFFF), np.uint64(1)).astype(np.int64)
    return (before * (start <= at - GRAM) << 16) | after * (end > at - GRAM)


def stretches(raw: np.ndarray, offsets: np.ndarray, length: int):
    """Anchor, content, document (position among the texts), place, number of strings and ``sides`` of every stretch.

    ``sides`` is 0 (unknown) where strings are short, texts long, or strings have their first gram of that value at several places.
    """
    empty = np.zeros(0, np.int64)
    long_enough = np.flatnonzero(np.diff(offsets) >= length)
    if not len(long_enough):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
    grams, strings = identifiers(raw, length)
    width = length - GRAM + 1
    least = sliding_min((grams & ~_AT_MASK) | (np.arange(len(grams), dtype=np.uint64) & _AT_MASK), width)
    count = np.diff(offsets)[long_enough] - length + 1
    begin = np.cumsum(count) - count
    place = np.arange(count.sum()) + np.repeat(offsets[long_enough] - begin, count)
    low = least[place]
    a = low >> _AT
    cut = np.ones(len(a), bool)
    cut[1:] = a[1:] != a[:-1]
    cut[begin] = True
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, len(a)))
    # a repeated gram can make a stretch longer than what its first and last string cover
    parts = -(-size // width)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + within * width
    size = np.minimum(np.repeat(size, parts) - within * width, width)
    start = place[first]
    content = mix(strings[start] * np.uint64(7) + strings[start + size - 1] * _PAIR + size.astype(np.uint64))
    doc = long_enough[np.searchsorted(begin, first, "right") - 1]
    if length < 3 * GRAM - 1 or len(raw) > int(_AT_MASK):
        side = np.zeros(len(first), np.int64)
    else:
        at = (low[first] & _AT_MASK).astype(np.int64)
        one = low[first] == low[first + size - 1]
        side = np.where(one, sides(grams, at, start, start + size - 1), 0)
    return a[first], content, doc, start - offsets[doc], size, side


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def sampled(rows: DataFrame, length: int) -> DataFrame:
    """``anchor, content, doc, at, side`` of every stretch; ``at`` is place * 256 + strings, negative if settled."""
    def scan(batches):
        for b in slices(batches, limit=SAMPLE_BYTES):
            raw, offsets = utf8(b.column("text"))
            anchor, content, doc, place, size, side = stretches(raw, offsets, length)
            row = b.column("row_id").to_numpy()[doc]
            order = np.lexsort((row, content, anchor))
            x, y, z = anchor[order], content[order], row[order]
            fresh = np.ones(len(x), bool)
            fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            least = z[fresh][np.cumsum(fresh) - 1]
            later = np.empty(len(x), bool)
            later[order] = z > least
            at = (place << 8) | size
            # text order, so that rows next to each other compress; settled rows need no bucket and go by document
            yield pa.RecordBatch.from_arrays(
                [_long(np.where(later, mix(row.astype(np.uint64)), anchor)), _long(np.where(later, np.uint64(0), content)),
                 _long(row), _long(np.where(later, -at, at)), pa.array(np.where(later, 0, side).astype(np.uint32).view(np.int32))],
                ["anchor", "content", "doc", "at", "side"])

    return rows.select("row_id", "text").mapInArrow(scan, "anchor long, content long, doc long, at long, side int")


def sharing(anchor: np.ndarray, doc: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Rows (whole anchor buckets, in order) that may share a string with another document, by their ``sides``."""
    edge = np.ones(len(anchor), bool)
    edge[1:] = anchor[1:] != anchor[:-1]
    bucket = np.cumsum(edge) - 1
    out = np.logical_or.reduceat(side == 0, np.flatnonzero(edge))[bucket]
    for value in (side >> 16, side & 0xFFFF):
        name = (bucket << 16) | value
        order = np.argsort(name, kind="stable")
        name, of = name[order], doc[order]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        begin = np.flatnonzero(new)
        several = np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin)
        out[order] |= several[np.cumsum(new) - 1] & (value[order] > 0)
    return out


def refine_contents(parts: DataFrame, most: int = HELD) -> DataFrame:
    """``anchor, doc, at``: stretches whose strings are to be refined, and removed ones (null anchor)."""
    def batch_of(gone, still):
        every = [*gone, *still]
        anchor = pa.concat_arrays([pa.nulls(sum(len(g[0]) for g in gone), pa.int64()), *[_long(t[2]) for t in still]])
        return pa.RecordBatch.from_arrays([anchor, _long(np.concatenate([t[0] for t in every])),
                                           _long(np.concatenate([t[1] for t in every]))], ["anchor", "doc", "at"])

    def kept(rows):
        doc, at, x, side = (np.concatenate([r[i] for r in rows]) for i in range(4))
        if not len(doc):
            return []
        stays = sharing(x, doc, side)
        return [(doc[stays], at[stays], x[stays])]

    def run(batches):
        # state of the anchor bucket that the last batch ended in
        last = None  # anchor, content, least doc of the content
        seen, mixed = None, False  # first least doc of the bucket; whether it has several
        waiting: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[np.ndarray, ...]] = []  # rows to refine of that bucket, as far as read
        whole = None  # a bucket too large to hold
        for b in batches:
            if not b.num_rows:
                continue
            x, y, doc, at = (b.column(c).to_numpy() for c in ("anchor", "content", "doc", "at"))
            side = b.column("side").to_numpy().view(np.uint32).astype(np.int64)
            settled = at < 0
            gone, still = [(doc[settled], -at[settled])], []
            x, y, doc, at, side = x[~settled], y[~settled], doc[~settled], at[~settled], side[~settled]
            if len(x):
                new_x = np.ones(len(x), bool)
                new_x[1:] = x[1:] != x[:-1]
                new_y = new_x.copy()
                new_y[1:] |= y[1:] != y[:-1]
                goes_on = last is not None and last[0] == x[0]
                least = doc[new_y][np.cumsum(new_y) - 1].copy()
                if goes_on and last[1] == y[0]:
                    stop = np.flatnonzero(new_y)[1] if new_y.sum() > 1 else len(x)
                    least[:stop] = last[2]
                later = doc > least
                gone.append((doc[later], at[later]))
                begin = np.flatnonzero(new_x)
                low, high = np.minimum.reduceat(least, begin), np.maximum.reduceat(least, begin)
                several = low != high
                if goes_on and (mixed or seen != low[0]):
                    several[0] = True
                if goes_on and several[0] and waiting:
                    still += waiting
                if not goes_on or several[0] or len(begin) > 1:
                    waiting = []
                end = begin[-1]
                bucket = np.cumsum(new_x) - 1
                now = ~later & several[bucket]
                still.append((doc[now], at[now], x[now], side[now]))
                if not several[-1]:  # all of one document so far
                    keep = ~later[end:]
                    waiting.append((doc[end:][keep], at[end:][keep], x[end:][keep], side[end:][keep]))
                seen = seen if goes_on and len(begin) == 1 else low[-1]
                mixed = bool(several[-1])
                last = (x[-1], y[-1], least[-1])
                # the bucket that the batch ended in waits for the rest of its rows
                own = [t[2] == last[0] for t in still]
                done = [tuple(c[~o] for c in t) for t, o in zip(still, own)]
                if held and held[0][2][0] != last[0]:
                    done, held = [*held, *done], []
                held += [tuple(c[o] for c in t) for t, o in zip(still, own) if o.any()]
                still = []
                if done and whole is not None:
                    still = [tuple(c[t[2] == whole] for c in t) for t in done]
                    done = [tuple(c[t[2] != whole] for c in t) for t in done]
                still += kept(done) if done else []
                if whole == last[0] or sum(len(t[0]) for t in held) > most:
                    whole, still, held = last[0], [*still, *held], []
            yield batch_of(gone, still)
        if held:
            yield batch_of([], kept(held))

    return (parts.repartition("anchor").sortWithinPartitions("anchor", "content", "doc")
            .mapInArrow(run, "anchor long, doc long, at long"))


def places_of(found: DataFrame) -> DataFrame:
    """``row_id, places``: the wanted stretches of a document, packed (4 bytes each, or 8 in texts of over 64 MB)."""
    def pack(batches):
        for b in batches:
            out = []
            for places in b.column("places"):
                at = np.sort(places.values.to_numpy())
                small = (at >> 8 << 6) | (at & 255)
                out.append(small.astype("<u4" if small[-1] < 1 << 32 else "<u8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array([len(p) for p in b.column("places")], pa.int64()),
                                              pa.array(out, pa.binary())], ["row_id", "n", "places"])

    return (found.groupBy(F.col("doc").alias("row_id")).agg(F.collect_list("at").alias("places"))  # of one document
            .mapInArrow(pack, "row_id long, n long, places binary"))


def fetch(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``anchor, doc, at, data``: the bytes of the wanted stretches (stored ``places_of``)."""
    def run(batches):
        for b in slices(batches, limit=4 * SAMPLE_BYTES):
            docs, ats, data = [], [], []
            for row, text, n, places in zip(b.column("row_id").to_pylist(), b.column("text"), b.column("n").to_pylist(),
                                            b.column("places")):
                raw = text.as_buffer().to_pybytes()
                small = np.frombuffer(places.as_buffer(), f"<u{len(places.as_buffer()) // n}").astype(np.int64)
                place, size = small >> 6, small & 63
                at, end = (place << 8) | size, place + size + length - 1
                data += [raw[s:e] for s, e in zip(place.tolist(), end.tolist())]
                docs.append(np.full(len(at), row))
                ats.append(at)
            joined = np.frombuffer(b"".join(data), np.uint8)
            begin = np.cumsum([0] + [len(x) for x in data])[:-1]
            grams, _ = identifiers(joined, length)
            anchor = grams[begin]
            for k in range(1, length - GRAM + 1):
                anchor = np.minimum(anchor, grams[begin + k])
            yield pa.RecordBatch.from_arrays([_long(anchor >> _AT), _long(np.concatenate(docs)), _long(np.concatenate(ats)),
                                              pa.array(data, pa.binary())], ["anchor", "doc", "at", "data"])

    total = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("places")), F.lit(0))).first()
    joined = join_checked(rows.select("row_id", "text"), wanted, "row_id", "inner", 64, total[0], total[1])
    return joined.mapInArrow(run, "anchor long, doc long, at long, data binary")


def string_buckets(raw: np.ndarray, length: int) -> np.ndarray:
    """Bucket of the ``length`` bytes at every place, refined from 8-byte buckets by pairs of bucket numbers."""
    word, size = raw.astype(np.uint64), 1
    while size < 8:
        word = (word[:-size] << np.uint64(8 * size)) | word[size:]
        size *= 2
    bucket = np.unique(word, return_inverse=True)[1].astype(np.uint64)
    while size < length:
        step = min(size, length - size)
        pair = (bucket[:-step] << np.uint64(32)) | bucket[step:]
        bucket = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        size += step
    return bucket


def later_strings(docs: np.ndarray, ats: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and ``at`` of runs of strings that an earlier document in the block has."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    begin = np.cumsum([0] + [len(x) for x in data])[:-1]
    size = ats & 255
    spot = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    bucket = string_buckets(raw, length)[spot]
    doc = np.repeat(docs, size)
    least = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, bucket.astype(np.int64), doc)
    later = doc > least[bucket.astype(np.int64)]
    stretch = np.repeat(np.arange(len(size)), size)
    edge = np.ones(len(spot), bool)
    edge[1:] = (later[1:] != later[:-1]) | (stretch[1:] != stretch[:-1])
    first = np.flatnonzero(edge)
    run = np.diff(np.append(first, len(spot)))
    first, run = first[later[first]], run[later[first]]
    place = (ats >> 8)[stretch[first]] + spot[first] - begin[stretch[first]]
    return doc[first], (place << 8) | run


def refine_strings(contexts: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """``doc, at`` of the strings to remove, anchor bucket by anchor bucket."""
    def run(batches):
        held: list[tuple] = []
        n = 0

        def settle(rows):
            docs, ats, data = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]), [x for r in rows for x in r[3]]
            if len(docs):
                d, t = later_strings(docs, ats, data, length)
                yield pa.RecordBatch.from_arrays([_long(d), _long(t)], ["doc", "at"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column("anchor").to_numpy(), b.column("doc").to_numpy(), b.column("at").to_numpy(),
                         b.column("data").to_pylist()))
            n += b.num_rows
            if n >= block:  # all but the last anchor bucket, which may go on
                a, d, t, x = held[-1]
                at = int(np.searchsorted(a == a[-1], True))  # sorted by anchor: the last bucket's first row
                if at:
                    yield from settle([*held[:-1], (a[:at], d[:at], t[:at], x[:at])])
                    held, n = [(a[at:], d[at:], t[at:], x[at:])], b.num_rows - at
        if held:
            yield from settle(held)

    return (contexts.repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(run, "doc long, at long"))


def refine_large(contexts: DataFrame, length: int) -> DataFrame:
    """The same for buckets too large for one block: their strings are grouped, with salt."""
    def explode(batches):
        for b in slices(batches, "data"):
            docs, places, strings = [], [], []
            for d, t, x in zip(b.column("doc").to_pylist(), b.column("at").to_pylist(), b.column("data").to_pylist()):
                for k in range(t & 255):
                    docs.append(d)
                    places.append((t >> 8) + k)
                    strings.append(x[k:k + length])
            yield pa.RecordBatch.from_pydict({"string": pa.array(strings, pa.binary()), "doc": pa.array(docs, pa.int64()),
                                              "place": pa.array(places, pa.int64())})

    strings = contexts.select("doc", "at", "data").mapInArrow(explode, "string binary, doc long, place long")
    return (grouped(strings, ["string"], ["doc", "place"], {"first": (F.min("doc"), F.min)}).filter("doc > first")
            .select("doc", (F.col("place") * 256 + 1).alias("at")))


def spans_of(removed: DataFrame, length: int) -> DataFrame:
    """``row_id, starts, ends``: maximal removed spans of every document that has some."""
    def merge(batches):
        for b in batches:
            rows, starts, ends = [], [], []
            for row, places in zip(b.column("row_id").to_pylist(), b.column("places")):
                at = np.sort(places.values.to_numpy())
                s, e = at >> 8, (at >> 8) + (at & 255) + length - 1
                reach = np.maximum.accumulate(e)
                new = np.ones(len(s), bool)
                new[1:] = s[1:] > reach[:-1]
                first = np.flatnonzero(new)
                rows.append(row)
                starts.append(s[first].tolist())
                ends.append(reach[np.append(first[1:], len(s)) - 1].tolist())
            yield pa.RecordBatch.from_pydict({"row_id": pa.array(rows, pa.int64()), "starts": pa.array(starts, pa.list_(pa.int64())),
                                              "ends": pa.array(ends, pa.list_(pa.int64()))})

    return (removed.groupBy(F.col("doc").alias("row_id")).agg(F.collect_list("at").alias("places"))  # of one document
            .mapInArrow(merge, "row_id long, starts array<long>, ends array<long>"))


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                    large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """``doc_id, kept`` (bytes), ``n_bytes, n_removed, starts, ends`` (removed spans) of every row."""
    if not GRAM <= length < GRAM + 63:
        raise ValueError(f"length must be {GRAM} to {GRAM + 62}")
    rows = keyed(docs, key, text)
    found = store(refine_contents(sampled(rows, length)), "contents")
    removed, still = found.filter("anchor is null").select("doc", "at"), found.filter("anchor is not null")
    # anchors of very many stretches: at most 1 / large of all
    crowded = store(still.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("anchor"), "crowded")
    if crowded.limit(1).count():
        dense = store(places_of(join_checked(still, crowded, "anchor", "left_semi", 16)), "dense")
        removed = removed.unionByName(refine_large(fetch(rows, dense, length), length))
        still = join_checked(still, crowded, "anchor", "left_anti", 16)
    wanted = store(places_of(still), "wanted")
    removed = removed.unionByName(refine_strings(fetch(rows, wanted, length), length, block))
    spans = store(spans_of(removed, length), "spans")
    n_spans = spans.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]
    joined = join_checked(rows, spans, "row_id", "left", 96, more=16 * n_spans)

    def cut(batches):
        for b in slices(batches):
            kept, size, gone = [], [], []
            for text, s, e in zip(b.column("text"), b.column("starts").to_pylist(), b.column("ends").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                size.append(len(raw))
                gone.append(sum(e or ()) - sum(s or ()))
                kept.append(b"".join(raw[x:y] for x, y in zip([0, *(e or ())], [*(s or ()), len(raw)])))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                 b.column("starts"), b.column("ends")], ["doc_id", "kept", "n_bytes", "n_removed", "starts", "ends"])

    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(
        cut, "doc_id long, kept binary, n_bytes long, n_removed long, starts array<long>, ends array<long>")
