"""Cross-tokenizer alignment by diagonal run skipping, and corpus-wide counts of linked ids.

Vocabulary A (byte-level BPE) reads a space and the text, vocabulary B
(sentencepiece, which adds that space itself) the text.  The tokens of both cover
the same bytes; byte offsets at which an A token and a B token end cut them into
groups.  ``skip_runs`` walks both arrays of token ends.  At the current index
shift it compares stretches of 1, 2, 4, 8, ... ends at once and jumps over what is
equal: those are one-to-one groups.  Where the stretch breaks, the group is
irregular; it is resolved by stepping on the side that lags until both ends meet,
every step being a link of two overlapping tokens, and the shift is updated.

Most words occur often, so a worker asks both libraries once for a chunk (white
space and what follows up to the next white space) and keeps the ids in a bounded
cache.  Neither vocabulary merges across the beginning of such a chunk; this is
checked on the vocabularies, and texts with characters for which it may not hold
are one chunk.

An id pair's count is the number of documents that hold it linked.  Tasks count
the pairs of their own documents before the shuffle.  Documents meet the counts
without a hot key: the most frequent pairs (at most ``FREQUENT`` of them, cut at
a step of a histogram of counts) are broadcast, links of all other pairs, each of
which is in few documents, are joined by shuffle.

Edge cases: a null or empty text, and one whose tokens do not give back its bytes
in both vocabularies, has no tokens: zeros and empty groups; special tokens inside
texts are plain text; repeated and null keys count row by row; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteCache, forget, keyed, segment_sums, slices, store, strings, trim, utf8, worker_cache

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are broadcast at most (17 bytes each).
FREQUENT = 1_000_000
#: Steps of the histogram of counts per doubling.
STEPS = 8
#: Pairs that a task counts before it hands them on.
PAIRS_AT_ONCE = 1 << 21
#: Text that a task encodes at once, and bytes of a generation of the cache of chunks.
SLICE, CACHE_BYTES = 2 << 20, 32 << 20
#: New chunks that are encoded in one call.
GROUP = 256
#: Ends that the first probe of a stretch compares.
PROBE = 4
#: White space at which a text may be cut, and characters whose texts are not cut.
BLANK = np.zeros(256, bool)
BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x20]] = True
UNCUT = "[\\x{0}-\\x{8}\\x{D}-\\x{1F}\\x{7F}-\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{2581}\\x{3000}]"

_UNCUT = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", UNCUT))


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B)


def byte_letters() -> dict[str, int]:
    """The byte that a letter of a byte-level vocabulary stands for: printable Latin-1 itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def skip_runs(ends_a: np.ndarray, ends_b: np.ndarray):
    """Groups of two ascending arrays of token ends that close with the same end.

    Returns the one-to-one runs (first A, first B, length), the irregular groups
    (first A, first B, A after, B after) and the links inside irregular groups
    (A token, B token), all as integer arrays of token positions.
    """
    n = len(ends_a)
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = ends_a.astype("<u4").tobytes(), ends_b.astype("<u4").tobytes()
    a.append(-1)  # closes the arrays: no end of the other side equals these
    b.append(-2)
    runs, odd, link_a, link_b = [], [], [], []
    more_a, more_b = link_a.append, link_b.append
    i = j = 0
    x, y = a[0], b[0]
    close = 4 * n
    while i < n:
        if x == y:
            first_a, first_b = i, j
            i += 1
            j += 1
            if a[i] == b[j]:
                # doubled stretches at this shift, then halved ones, then single ends up to the break;
                # p, q, k count bytes, and bytes equal to a full stretch of A are a full stretch of B
                p, q, k = 4 * i, 4 * j, 4 * PROBE
                while p + k <= close and raw_a[p:p + k] == raw_b[q:q + k]:
                    p += k
                    q += k
                    k *= 2
                while k > 4 * PROBE:
                    k //= 2
                    if p + k <= close and raw_a[p:p + k] == raw_b[q:q + k]:
                        p += k
                        q += k
                i, j = p // 4, q // 4
                while a[i] == b[j]:
                    i += 1
                    j += 1
            runs += first_a, first_b, i - first_a
            if i == n:
                break
            x, y = a[i], b[j]
        first_a, first_b = i, j
        more_a(i)
        more_b(j)
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
            more_a(i)
            more_b(j)
        i += 1
        j += 1
        odd += first_a, first_b, i, j
        x, y = a[i], b[j]
    return (np.array(runs, np.int64).reshape(-1, 3), np.array(odd, np.int64).reshape(-1, 4),
            np.array(link_a, np.int64), np.array(link_b, np.int64))


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``length[i]`` of them, for all i."""
    ends = np.cumsum(length)
    return np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


class Encoders:
    """Ids of both vocabularies for whole texts, chunk by chunk."""

    def __init__(self, path_a: str, path_b: str, capacity: int = CACHE_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters, n = byte_letters(), self.a.get_vocab_size(with_added_tokens=True)
        self.bytes_a = [b""] * n
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in letters for c in token)
            self.bytes_a[i] = bytes(letters[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        self.cuts = self._cuts_alike(pieces)
        self.chunks = ByteCache(capacity)
        self._text = self._decimals()

    def _cuts_alike(self, pieces: list[str]) -> bool:
        """Whether chunks can be encoded alone in both vocabularies."""
        made = json.loads(self.a.to_str())
        first = made.get("pre_tokenizer") or {}
        fine_a = made.get("normalizer") is None and first.get("type") == "ByteLevel" \
            and first.get("use_regex") and not first.get("add_prefix_space")
        fine_b = self.b.encode("a  b ", out_type=str)[-1:] == ["▁"] and not any(
            "▁" in p.lstrip("▁") or len(p) > 1 and any(c in p for c in "\t\n\x0b\x0c")
            for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i))
        return bool(fine_a and fine_b)

    def _decimals(self):
        """Ids as decimal letters with a separator: A's inside a group, A's last, B's inside, B's last; and their lengths."""
        out = [f"{i}{end}".encode() for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;"))
               for end in ends for i in range(n)]
        size = np.array([len(x) for x in out], np.int64)
        width = int(size.max())
        return np.frombuffer(b"".join(x.ljust(width) for x in out), np.uint8).reshape(-1, width), size

    def _new(self, chunks: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of chunks, many in one call: strung together they are a text that would be cut into them again."""
        alone = [c for c in chunks if not self.cuts or c[-1] in " \t\n\v\f" or _UNCUT.search(c)]
        apart = set(alone)
        together = [c for c in chunks if c not in apart]
        known = {}
        for groups in ([together[i:i + GROUP] for i in range(0, len(together), GROUP)], [[c] for c in alone]):
            if not groups:
                continue
            texts = ["".join(g) for g in groups]
            ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            ids_b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
            for g, t, x, y in zip(groups, texts, ids_a, ids_b):
                if t[0] != " ":
                    y = y[1:]  # the space that B adds
                elif t == " ":
                    y = [self.space]
                fine = b"".join(map(self.bytes_a.__getitem__, x)) == t.encode() == b"".join(map(self.bytes_b.__getitem__, y))
                if len(g) == 1:
                    known[t] = np.array(x, "<u4").tobytes(), np.array(y, "<u4").tobytes(), fine
                elif not fine:
                    known.update((c, self._new_alone(c)) for c in g)
                else:
                    ends = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in g])
                    cut = []
                    for ids, size in ((x, self.size_a), (y, self.size_b)):
                        ids = np.array(ids, "<u4")
                        cut += [ids.tobytes(), (4 * np.searchsorted(np.cumsum(size[ids]), ends, "right")).tolist()]
                    raw_a, at_a, raw_b, at_b = cut
                    own_a = [raw_a[i:k] for i, k in zip([0, *at_a], at_a)]
                    own_b = [raw_b[i:k] for i, k in zip([0, *at_b], at_b)]
                    known.update(zip(g, zip(own_a, own_b, [True] * len(g))))
        return [known[c] for c in chunks]

    def _new_alone(self, chunk: str) -> tuple[bytes, bytes, bool]:
        x = self.a.encode(chunk, add_special_tokens=False).ids
        y = self.b.encode(chunk[1:]) if chunk[0] == " " else self.b.encode(chunk)[1:]
        fine = b"".join(self.bytes_a[i] for i in x) == chunk.encode() == b"".join(self.bytes_b[i] for i in y)
        return np.array(x, "<u4").tobytes(), np.array(y, "<u4").tobytes(), fine

    def encode(self, texts):
        """Ids of A and of B for all texts in a row, and each one's n + 1 borders; texts without tokens are empty."""
        full = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x.cast(pa.large_string())
                                             for x in (" ", texts, "")))
        raw, at = utf8(full)
        blank = BLANK[raw]
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        if self.cuts:
            whole = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)
        else:
            whole = np.ones(len(texts), bool)
        if whole.any():
            start &= ~np.repeat(whole, np.diff(at))
        start[at[:-1]] = True
        cut = np.append(np.flatnonzero(start), len(raw))
        coded = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(raw)).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        known = self.chunks.lookup(strings(coded.dictionary), self._new)
        borders = np.searchsorted(cut, at)
        wrong = np.array([not k[2] for k in known], bool)[codes]
        none = (segment_sums(wrong.astype(np.int64), borders) > 0) | (np.diff(at) == 1)
        out = []
        for side in (0, 1):
            flat = np.frombuffer(b"".join(k[side] for k in known), "<u4")
            size = np.array([len(k[side]) for k in known], np.int64) // 4
            first = np.cumsum(size) - size
            each = size[codes]
            each[np.repeat(none, np.diff(borders))] = 0
            out += [flat[ranges(first[codes], each)].astype(np.int64), np.concatenate(([0], np.cumsum(each)))[borders]]
        return out

    def align(self, texts):
        """Of all texts: tokens of A and B, groups, links, the text of the groups, and the linked pairs with their times."""
        a, at_a, b, at_b = self.encode(texts)
        runs, odd, link_a, link_b = skip_runs(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
        last_a[ranges(odd[:, 0], odd[:, 2] - odd[:, 0] - 1)] = False
        last_b[ranges(odd[:, 1], odd[:, 3] - odd[:, 1] - 1)] = False
        link_a = np.concatenate((ranges(runs[:, 0], runs[:, 2]), link_a))
        link_b = np.concatenate((ranges(runs[:, 1], runs[:, 2]), link_b))
        n = len(at_a) - 1
        doc = np.repeat(np.arange(n), np.diff(at_a))[link_a]
        links = np.bincount(doc, minlength=n)
        pairs, times = np.unique(doc * (len(self.size_a) * len(self.size_b)) + a[link_a] * len(self.size_b) + b[link_b],
                                 return_counts=True)
        doc, pairs = np.divmod(pairs, len(self.size_a) * len(self.size_b))
        held = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
        return (np.diff(at_a), np.diff(at_b), segment_sums(last_a.astype(np.int64), at_a), links,
                self._groups(a, b, last_a, last_b, at_a, at_b), held, pairs, times)

    def _groups(self, a, b, last_a, last_b, at_a, at_b):
        """``a1,a2|b1;a3|b2,b3`` of every text, as an Arrow array."""
        letters, size = self._text
        va, vb = len(self.size_a), len(self.size_b)
        # an A token follows the B tokens of all groups before its own, a B token the A tokens up to its own group
        before = np.concatenate(([0], np.flatnonzero(last_b) + 1))[np.cumsum(last_a) - last_a]
        upto = (np.flatnonzero(last_a) + 1)[np.cumsum(last_b) - last_b]
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + before] = a + va * last_a
        code[np.arange(len(b)) + upto] = 2 * va + b + vb * last_b
        length = size[code]
        close = (at_a + at_b)[1:][np.diff(at_a) > 0] - 1
        length[close] -= 1  # nothing after a text's last token
        text = letters[code][np.arange(letters.shape[1]) < length[:, None]]
        ends = np.concatenate(([0], np.cumsum(length)))[at_a + at_b]
        return pa.LargeStringArray.from_buffers(len(at_a) - 1, pa.py_buffer(ends), pa.py_buffer(text)).cast(pa.string())


def encoders(path_a: str, path_b: str) -> Encoders:
    """One pair of encoders per Python worker."""
    return worker_cache(("pairs", path_a, path_b), lambda: Encoders(path_a, path_b))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its groups as text, its counts, and its linked pairs.

    ``row_id, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times``; a pair
    is A's id times the size of B's vocabulary plus B's id, ``times`` says how
    often the document holds it.
    """
    own_a, own_b = default_vocabularies()
    path_a, path_b = path_a or own_a, path_b or own_b
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in
                        ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()),
                        ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches):
        enc = encoders(path_a, path_b)
        for batch in slices(batches, limit=SLICE):
            n_a, n_b, groups, links, written, held, pairs, times = enc.align(batch.column("text"))
            held = pa.array(held.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, groups, links)),
                 written, pa.ListArray.from_arrays(held, pa.array(pairs.astype(np.int64))),
                 pa.ListArray.from_arrays(held, pa.array(times.astype(np.int32)))], schema=schema)
        trim()

    return keyed(docs, key, text).mapInArrow(
        run, "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
             "pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """Every pair with ``n``, the documents that hold it, and whether no pair of its A id has more (stored)."""
    def run(batches):
        forget()
        held, size, rest = [], 0, None
        for batch in batches:
            held.append(batch.column("pairs").flatten().to_numpy())
            size += len(held[-1])
            if size >= PAIRS_AT_ONCE:
                rest = _added(rest, held)
                held, size = [], 0
                if len(rest[0]) >= PAIRS_AT_ONCE:
                    yield _counted(rest)
                    rest = None
        yield _counted(_added(rest, held))
        trim()

    counts = (aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    counts = store(counts.withColumn("a", F.expr(f"pair div {size_b}")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row per id of A
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _added(rest, held):
    pairs, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
    if rest is None:
        return pairs, n
    both, where = np.unique(np.concatenate((rest[0], pairs)), return_inverse=True)
    return both, np.bincount(where, np.concatenate((rest[1], n)), len(both)).astype(np.int64)


def _counted(rest):
    return pa.RecordBatch.from_arrays([pa.array(rest[0].astype(np.int64)), pa.array(rest[1].astype(np.int64))], ["pair", "n"])


def with_counts(aligned: DataFrame, size_b: int, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` (a stored table) with ``n_best`` and ``count_sum`` instead of its pairs."""
    spark = aligned.sparkSession
    step = F.floor(F.log2(F.col("n").cast("double")) * STEPS).cast("int")
    counts = store(pair_counts(aligned, size_b).withColumn("step", step), "pairs")
    seen = sorted(((r["step"], r["pairs"]) for r in counts.groupBy("step").agg(F.count(F.lit(1)).alias("pairs")).collect()),
                  reverse=True)  # at most STEPS times 63 rows
    lowest, taken = None, 0
    for s, pairs in seen:
        if taken + pairs > frequent:
            break
        lowest, taken = s, taken + pairs
    top = counts.filter(F.lit(False) if lowest is None else F.col("step") >= lowest).select("pair", "n", "best").toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    # at most ``frequent`` entries
    known = spark.sparkContext.broadcast((top.column("pair").to_numpy()[order], top.column("n").to_numpy()[order],
                                          top.column("best").to_numpy()[order]))
    keep = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches):
        forget()
        pair, n, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            at = lists.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            own, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            where = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            hit = pair[where] == own if len(pair) else np.zeros(len(own), bool)
            value = np.where(hit, n[where], 0) if len(pair) else np.zeros(len(own), np.int64)
            first = np.where(hit, best[where], False) if len(pair) else np.zeros(len(own), bool)
            left = pa.array(np.concatenate(([0], np.cumsum(~hit)))[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(segment_sums(times * first, at)), pa.array(segment_sums(times * value, at)),
                   pa.ListArray.from_arrays(left, pa.array(own[~hit])), pa.ListArray.from_arrays(left, pa.array(times[~hit]))],
                [*keep, "n_best", "count_sum", "pairs", "times"])
        trim()

    kinds = ", ".join(f"{c} {t}" for c, t in aligned.select(*keep).dtypes)
    known_part = aligned.mapInArrow(run, f"{kinds}, n_best long, count_sum long, pairs array<long>, times array<long>")
    if taken == sum(pairs for _, pairs in seen):
        return known_part.drop("pairs", "times")
    known_part = store(known_part, "known-pairs")
    rare = counts.filter(F.lit(True) if lowest is None else F.col("step") < lowest).select("pair", "n", "best")
    more = (known_part.select("row_id", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
            .select("row_id", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
            .join(rare.hint("shuffle_hash"), "pair").groupBy("row_id")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("more_best"),
                 F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    return (known_part.drop("pairs", "times").join(more, "row_id", "left")
            .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).drop("more_best", "more_sum"))


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, key: str = "doc_id",
              text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per row: ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and the SHA-256 of its groups' text ('' without tokens)."""
    from sentencepiece import SentencePieceProcessor

    own_a, own_b = default_vocabularies()
    size_b = SentencePieceProcessor(model_file=path_b or own_b).get_piece_size()
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    aligned = store(align(docs, path_a or own_a, path_b or own_b, key, text)
                    .withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return with_counts(aligned, size_b, frequent).drop("row_id")
