"""N-gram Jaccard join by token-combination prefixes.

A text's set holds its distinct ``n``-word shingles (64-bit hashes).  Two sets
link when their Jaccard similarity is at least ``percent`` / 100, so a set of
size s may miss at most t = s - ceil(s * percent / 100) shingles of a partner.

1. Frequent class: shingles in at least ``1 / FREQUENT`` of all documents.  There
   are at most FREQUENT times the mean set size of them whatever the input
   size; their sorted hashes are broadcast.
2. All shingles have one order: rare ones by hash, then frequent ones by hash.
   A document indexes the shortest prefix that t lost shingles cannot destroy:
   rare shingles singly; where these do not suffice, the prefix is extended by
   frequent shingles, which are indexed only as pairs within a hash class, so a
   class with c of them outlasts c - 1 losses.  Classes number about a sixteenth
   of the set size, and a set close to a border uses both class counts.  Of two
   linked sets, the one whose prefix ends first keeps a rare shingle or a pair in
   the other's prefix.
3. Equal sets are one class from here on.  Of index entries in which the same
   classes meet, one is kept.  Every entry with two or more classes offers each class one partner, a class picked by hash (in a second
   round: one of another component); pairs are cut by size and by a parity
   sketch (the number of differing bits never exceeds the number of differing
   shingles), and each class's nearest candidate is verified on the real sets.
   Linked classes are merged into components.
4. Only pairs of one entry that are still in different components are left.
   They are cut the same way and all verified.  So no group emits all its pairs,
   and no link between different components is missed.

Edge cases: null text is empty; a text without words has an empty set and links
with nothing; with fewer than ``n`` words the whole sequence is one shingle;
rows that share a doc_id are rows of their own, with the same set in one
component; null doc_ids are never the smallest unless all are null; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, forget, join_checked, keyed, mix, numbered, slices, store, trim, without
from .components import components

N, PERCENT = 3, 90
#: A shingle is frequent in at least one of so many documents.
FREQUENT = 16000
#: Rounds in which every class is offered one partner per entry before the remaining pairs are listed.
ROUNDS = 2
#: Shingles a task counts before it sends what may be frequent.
CHUNK = 2_000_000
#: Bits of a parity sketch: the next power of two from half the set size, this at least.
SKETCH_BITS = 512
#: Least entries of a class by which the crossing join sees that a pair has met before.
FIRSTS = 12
#: Mean size of a class of frequent shingles.
CLASS_SIZE = 16


def shingle_sets(texts, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words with A-Z in lower case."""
    w = Words(pc.ascii_lower(texts))
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, w.distinct.cast(pa.binary()).to_pylist()), np.uint64, len(w.distinct))
    word = known[w.codes]
    size = max(len(word) - n + 1, 0)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = mix(h ^ word[k:k + size]) + np.uint64(k + 1)
    out = []
    for s, e in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
        if e - s >= n:
            out.append(np.unique(h[s:e - n + 1]))
        elif e > s:
            out.append(np.array([xxhash.xxh3_64_intdigest(word[s:e].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def frequent_shingles(rows: DataFrame, n: int, frequent: int = FREQUENT, chunk: int = CHUNK) -> np.ndarray:
    """Sorted hashes of the frequent class.

    A chunk of documents sends the shingles that at least 1 in ``frequent`` of
    its documents have; a shingle as frequent as that overall is so in some chunk.
    """
    def count(batches):
        held: list[np.ndarray] = []

        def flush():
            every, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= max(2, len(held) / frequent)
            return pa.RecordBatch.from_arrays(
                [pa.array(every[often].view(np.int64), pa.int64()), pa.array(times[often], pa.int64())], ["shingle", "n"])

        forget()
        size = 0
        for b in slices(batches):
            for s in shingle_sets(b.column("text"), n):
                held.append(s)
                size += len(s)
            if size >= chunk:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        held = []
        trim()

    least = max(rows.count() / frequent, 2)
    found = (rows.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
             .filter(F.col("n") >= least).select("shingle").toArrow())  # 8 bytes a row on the driver, not a Python object
    out = np.sort(found.column("shingle").to_numpy().view(np.uint64))
    del found
    trim()
    return out


def levels(size: int, percent: int) -> set[int]:
    """Logarithms of the class counts used by a set of this size and by any it may link with."""
    return {max(0, int(s) // CLASS_SIZE).bit_length() for s in (-(-size * percent // 100), size * 100 // percent)}


def signatures(shingles: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index entries of a set (sorted hashes); ``frequent`` marks those of the frequent class."""
    size = len(shingles)
    losses = size - -(-size * percent // 100)
    rare = shingles[~frequent][:losses + 1]
    need = losses + 1 - len(rare)
    if need <= 0:
        return rare
    often = shingles[frequent]
    out = [rare]
    for level in levels(size, percent):
        kind = (mix(often + np.uint64(3)) & np.uint64((1 << level >> 1) - 1 if level else 0)).astype(np.int64)
        _, first = np.unique(kind, return_index=True)
        gain = np.ones(len(often), np.int64)
        gain[first] = 0
        stop = int(np.searchsorted(np.cumsum(gain), need)) + 1
        order = np.lexsort((often[:stop], kind[:stop]))
        k, t = kind[:stop][order], mix(often[:stop][order] + np.uint64(level))
        for step in range(1, len(k)):
            same = k[step:] == k[:-step]
            if not same.any():
                break
            out.append(mix(t[:-step][same] ^ (t[step:][same] * np.uint64(5))))
    return np.concatenate(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles per bit, as words; half as many bits are the first half xor the second."""
    bits = max(SKETCH_BITS, 1 << max(len(shingles) // 2 - 1, 0).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def differing(a, b) -> np.ndarray:
    """Bits in which the sketches (Arrow lists of words) of each pair differ, folded to the shorter of the two."""
    out = np.zeros(len(a), np.int64)
    first = [x.offsets.to_numpy().astype(np.int64) for x in (a, b)]
    words = [x.values.to_numpy().view(np.uint64) for x in (a, b)]
    size = np.stack([np.diff(x) for x in first], axis=1)
    for la, lb in np.unique(size, axis=0).tolist():
        at = np.flatnonzero((size[:, 0] == la) & (size[:, 1] == lb))
        x, y = (w[f[:-1][at][:, None] + np.arange(n)] for w, f, n in zip(words, first, (la, lb)))
        least = min(x.shape[1], y.shape[1])
        x, y = (np.bitwise_xor.reduce(v.reshape(len(at), -1, least), axis=1) for v in (x, y))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def index_sets(rows: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``row_id, doc_id, n, cls, sketch, folded, entries`` of every row.

    ``cls`` is a hash of the whole set; ``folded`` is the sketch folded to ``SKETCH_BITS`` bits.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches):
        forget()
        often = shared.value
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), n)
            size = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            if len(often):
                at = np.minimum(np.searchsorted(often, every), len(often) - 1)
                marked = often[at] == every
            else:
                marked = np.zeros(len(every), bool)
            ends = np.cumsum(size)
            entries = [signatures(s, marked[e - len(s):e], percent).view(np.int64) for s, e in zip(sets, ends)]
            cls = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            flat = np.concatenate(entries) if entries else np.zeros(0, np.int64)
            borders = np.concatenate(([0], np.cumsum([len(x) for x in entries]))).astype(np.int32)
            sketches = [sketch(s) for s in sets]
            short = [np.bitwise_xor.reduce(x.reshape(-1, SKETCH_BITS // 64), axis=0) for x in sketches]
            yield pa.RecordBatch.from_arrays(
                [b.column("row_id"), b.column("doc_id"), pa.array(size), pa.array(cls, pa.int64()), pa.array(sketches, pa.list_(pa.int64())),
                 pa.array(short, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(borders), pa.array(flat))],
                ["row_id", "doc_id", "n", "cls", "sketch", "folded", "entries"])
        trim()

    return rows.select("row_id", "doc_id", "text").mapInArrow(
        scan, "row_id long, doc_id long, n long, cls long, sketch array<long>, folded array<long>, entries array<long>")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that size and sketch allow to link, with ``gap``: the least distance the sketch proves.

    The classes grow with the input and would pass through the driver as a broadcast: they are joined by shuffle.
    """
    for side in ("a", "b"):
        own = classes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("folded").alias(f"folded_{side}"))
        pairs = pairs.join(own.hint("shuffle_hash"), side)
    # the short sketches cut most pairs; whole sketches travel only with what is left
    pairs = pairs.filter(allowed(percent)).drop("folded_a", "folded_b")
    for side in ("a", "b"):
        own = classes.select(F.col("cls").alias(side), F.col("sketch").alias(f"s_{side}"))
        pairs = pairs.join(own.hint("shuffle_hash"), side)

    def run(batches):
        for b in batches:
            differ = differing(b.column("s_a"), b.column("s_b"))
            both = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            # |a xor b| <= (1 - j) / (1 + j) * (|a| + |b|)
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(differ / both)], ["a", "b", "gap"])
            yield out.filter(pa.array(differ * (100 + percent) <= (100 - percent) * both))

    return pairs.mapInArrow(run, "a long, b long, gap double")


def allowed(percent: int):
    """Whether sizes and short sketches of a pair leave room for a link: |a xor b| <= (1 - j) / (1 + j) * (|a| + |b|)."""
    bits = sum(F.bit_count(F.col("folded_a")[k].bitwiseXOR(F.col("folded_b")[k])) for k in range(SKETCH_BITS // 64))
    return ((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            & (bits * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))))


def longer_sketches():
    """Differing bits of ``sketch_a`` and ``sketch_b``, the longer one folded once; 0 where that does not make them alike."""
    def fold(own: str, other: str):
        half = (F.size(own) / 2).cast("int")
        halves = F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) == 2 * F.size(other), halves).otherwise(F.col(own))

    bits = F.zip_with(fold("sketch_a", "sketch_b"), fold("sketch_b", "sketch_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    longer, shorter = F.greatest(F.size("sketch_a"), F.size("sketch_b")), F.least(F.size("sketch_a"), F.size("sketch_b"))
    return F.when(longer <= 2 * shorter, F.aggregate(bits, F.lit(0), lambda acc, x: acc + x)).otherwise(F.lit(0))


def verify(pairs: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Of stored pairs (a, b) those whose real sets link."""
    needed = store(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
                   .join(classes.select("cls", F.col("rep").alias("row_id")), "cls"), "needed")

    def build(batches):
        forget()
        for b in slices(batches):
            sets = [s.tobytes() for s in shingle_sets(b.column("text"), n)]
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(sets, pa.binary())], ["cls", "shingles"])
        trim()

    sets = store(join_checked(rows.select("row_id", "text"), needed, "row_id", "inner", 32)
                 .select("cls", "text").mapInArrow(build, "cls long, shingles binary"), "sets", "uncompressed")

    def check(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = (pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b"))
    return both.mapInArrow(check, "a long, b long")


def meetings(entries: DataFrame, percent: int | None = None) -> DataFrame:
    """Distinct rows (cls, entry) of the entries in which two or more classes meet; entries travel once, none is broadcast.

    With ``percent``, rows have the set size ``n``, and classes meet only if their sizes allow a link: an entry is cut
    where the next larger class is too large for the one before it, the first part keeps the entry's name, and a class
    that is alone in its part is dropped.  Two classes whose sizes allow a link are always in one part.
    """
    same = Window.partitionBy("entry")
    met = (entries.select("*", F.min("cls").over(same).alias("x"), F.max("cls").over(same).alias("y"))
           .filter("x < y").drop("x", "y").distinct())
    if percent is None:
        return met
    along = Window.partitionBy("entry").orderBy("n", "cls")
    met = (met.withColumn("joins", F.coalesce(100 * F.lag("n").over(along) >= percent * F.col("n"), F.lit(False)))
           .withColumn("joined", F.coalesce(100 * F.col("n") >= percent * F.lead("n").over(along), F.lit(False)))
           .withColumn("part", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))))
    name = F.when(F.col("part") == 1, F.col("entry")).otherwise(F.xxhash64("entry", "part"))
    return met.filter("joins or joined").select("cls", name.alias("entry"))


def one_of_each(met: DataFrame) -> DataFrame:
    """Rows (cls, entry) of one entry for each set of classes that meet: entries of the same classes offer the same pairs."""
    kinds = met.groupBy("entry").agg(
        F.bit_xor(F.xxhash64("cls")).alias("x"), F.count(F.lit(1)).alias("members"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    return met.join(kinds.groupBy("x", "members", "low", "high").agg(F.min("entry").alias("entry")).select("entry"), "entry")


def unsettled(met: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of entries in which several components meet, with their ``component``."""
    held = met.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = held.groupBy("entry").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("entry")
    return held.join(mixed, "entry")


def offers(held: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs: every class with one class of its entry's least component, or of the greatest if it is in that."""
    pick = F.col("cls").bitwiseXOR(F.xxhash64("entry", F.lit(turn)))
    leads = held.groupBy("entry", "component").agg(F.min(F.struct(pick.alias("k"), "cls")).alias("lead"))
    ends = leads.groupBy("entry").agg(F.min(F.struct("component", "lead.cls")).alias("x"), F.max(F.struct("component", "lead.cls")).alias("y"))
    lead = F.when(F.col("component") == F.col("x.component"), F.col("y.cls")).otherwise(F.col("x.cls"))
    return held.select("entry", "cls", "component").join(ends, "entry").select(lead.alias("a"), F.col("cls").alias("b")).distinct()


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT,
               frequent: int = FREQUENT) -> DataFrame:
    """``row_id, doc_id, n_shingles, class_id, component_id`` of every row."""
    rows = keyed(docs, key, text)
    often = frequent_shingles(rows, n, frequent)
    sets = store(index_sets(rows, n, percent, often), "shingle-index")
    del often
    trim()
    classes = store(sets.filter("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min("row_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"),
        F.min("folded").alias("folded"), F.count(F.lit(1)).alias("members")), "classes")
    entries = sets.filter("n > 0").select("cls", "n", F.explode("entries").alias("entry"))
    met = store(meetings(entries, percent), "met")
    met = store(one_of_each(met), "kinds")

    links, parts = None, met.select(F.col("cls").alias("node"), F.col("cls").alias("component")).limit(0)
    for k in range(ROUNDS):
        held = store(unsettled(met, parts), f"held-{k}") if k else met.withColumn("component", F.col("cls"))
        near = store(likely(offers(held, k), classes, percent).groupBy("b").agg(F.min(F.struct("gap", "a")).alias("best"))
                     .select("b", F.col("best.a").alias("a")), "offers")
        if not near.limit(1).count():
            break
        new = store(verify(near, rows, classes, n, percent), f"links-{k}")
        links = new if links is None else links.unionByName(new)
        parts = store(components(links), f"components-{k}")

    # what is left within an entry: pairs of different components
    held = store(unsettled(met, parts), "open")
    held = held.join(classes.select("cls", "n", "sketch").hint("shuffle_hash"), "cls")
    # sets with the shortest sketch share many entries with their near copies: they carry their first ones
    firsts = (held.where(F.size("sketch") == SKETCH_BITS // 64).groupBy("cls")
              .agg(F.slice(F.sort_array(F.collect_list("entry")), 1, FIRSTS).alias("firsts")))
    held = held.join(firsts, "cls", "left")
    own = ("cls", "component", "n", "sketch", "firsts")
    left, right = (held.select("entry", *[F.col(c).alias(f"{c}_{side}") for c in own]) for side in "ab")
    # a pair is listed in its least common entry, and in another only where the classes' first entries do not show that one
    before = [F.filter(f"firsts_{side}", lambda x: x < F.col("entry")) for side in "ab"]
    possible = ((F.col("component_a") != F.col("component_b")) & (F.col("cls_a") < F.col("cls_b"))
                & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
                & ~F.coalesce(F.arrays_overlap(*before), F.lit(False))
                & (longer_sketches() * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))))
    crossing = left.join(right, "entry").filter(possible).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
    more = store(likely(crossing, classes, percent), "crossing")
    if more.limit(1).count():
        new = verify(more, rows, classes, n, percent)
        parts = store(components(new if links is None else links.unionByName(new)), "components")

    of_class = classes.select("cls", "least", "members").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    least = of_class.filter("component is not null").groupBy("component").agg(F.min("least").alias("group_least"))
    named = store(of_class.join(least, "component", "left").filter("members > 1 or component is not null")
                  .select("cls", "least", F.coalesce("group_least", "least").alias("group_least")), "named")
    return join_checked(sets.select("row_id", "doc_id", "n", "cls"), named, "cls", "left", 48).select(
        "row_id", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("class_id"),
        F.coalesce("group_least", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **join) -> DataFrame:
    """One row of every component (of the smallest key, null last), columns as they were; rows are judged one by one."""
    rows, row = numbered(docs, key, text, nulls_first=False)
    linked = ngram_join(rows, row, text, **join)
    return without(rows, row, linked.filter("doc_id != component_id").select("doc_id")).drop(row)
