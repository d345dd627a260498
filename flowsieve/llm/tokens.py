"""Token ids of whole texts with the ``tokenizers`` library.

Texts of one corpus share most of their words, and the library spends most of
its time on merging a word's bytes.  The vocabulary used here drops white space
and never merges across it, so the ids of a text are those of its words put
together; every worker asks the library once for a word and keeps the answer in
a bounded cache.  A vocabulary for which this does not hold (it is probed) is
applied to whole texts instead.
"""

from __future__ import annotations

import json
import zlib
from array import array
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ByteCache, Words, segment_sums, slices, strings, trim, utf8, worker_cache

#: Id appended to every document.
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Text that a task encodes at once, and bytes of a generation of the cache of pieces.
SLICE, CACHE_BYTES = 3 << 20, 48 << 20


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


PROBE = "It's  the CAFÉ,\n\tİstanbul: 12,345 #tags && <b>naïve</b> ...ok 's x'll ﬁne ẞ 漢字 ́a"


SIMPLE_PROBE = "The end. A,b;c--d 12 3x4y!? ÀÉÎÕÜ ßÿ ñandú\t(#tag) $5.00 \"quoted\" x_y <b>&amp;</b> UP!!"
#: What the vocabulary's pattern separates besides letters; apostrophes (contractions) are not simple.
CUT = r"([!-/:-@\[-`{-~]+|[0-9])"
#: Bytes of simple texts: ASCII but for control characters and the apostrophe, and the Latin-1 letters.
SIMPLE = np.zeros(256, bool)
SIMPLE[[*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3]] = True
SIMPLE[[0x27, 0x97, 0xB7]] = False


def simple(texts) -> np.ndarray:
    """Mask of the texts of simple characters (lower-casing and composing them are the same everywhere)."""
    raw, offsets = utf8(texts)
    odd = ~SIMPLE[raw]
    if len(raw) > 1:  # what may be a special token
        odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
    return segment_sums(odd, offsets) == 0


class WordEncoder:
    """Ids of texts as the library gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str, capacity: int = CACHE_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width, self.kind = ("<u2", "H") if self.tok.get_vocab_size() < 1 << 16 else ("<u4", "I")
        self.wide = array(self.kind).itemsize
        self.words, self.pieces = ByteCache(capacity // 4), ByteCache(capacity)
        self.by_piece = self._cuts_alike()
        self.by_word = self._whole([PROBE])[0] == b"".join(self._whole(PROBE.split()))

    def _cuts_alike(self) -> bool:
        """Whether the vocabulary's file lower-cases, and cuts into letters, single digits and the rest."""
        steps = (json.loads(self.tok.to_str()).get("pre_tokenizer") or {}).get("pretokenizers", [])
        if not any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") for s in steps):
            return False
        ids, _ = self._by_pieces(pa.array([SIMPLE_PROBE]))
        return ids.tobytes() == self._whole([SIMPLE_PROBE])[0]

    def _pack(self, ids) -> bytes:
        return array(self.kind, ids).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_pieces(self, pieces: list[str]) -> list[bytes]:
        """Merge each piece; the library's pre-tokeniser first maps what is not ASCII to its byte letters."""
        pieces = list(pieces)
        other = [i for i, p in enumerate(pieces) if not p.isascii()]
        if other:
            mapped = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(" ".join(pieces[i] for i in other))]
            for i, p in zip(other, mapped):
                pieces[i] = p
        merge = self.tok.model.tokenize
        ids = [[t.id for t in merge(p)] for p in pieces]
        raw = self._pack(chain.from_iterable(ids))
        ends = [0, *accumulate(len(x) * self.wide for x in ids)]
        return [raw[s:e] for s, e in pairwise(ends)]

    def _expand(self, w: Words, known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order and the borders between texts, from the ids of the distinct words."""
        flat = np.frombuffer(b"".join(known), self.width)
        size = np.fromiter(map(len, known), np.int64, len(known)) // flat.itemsize
        first = np.cumsum(size) - size
        per_word = size[w.codes]
        ends = np.cumsum(per_word)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(first[w.codes] - (ends - per_word), per_word)
        at += np.arange(total)
        return flat[at], np.concatenate(([0], ends))[w.offsets]

    def _by_words(self, texts):
        w = Words(texts)
        return self._expand(w, self.words.lookup(strings(w.distinct), self._whole))

    def _by_pieces(self, texts):
        """For texts of ``simple`` characters: white space around what the vocabulary's pattern cuts off."""
        w = Words(pc.replace_substring_regex(pc.utf8_lower(texts), CUT, r" \1 "))
        return self._expand(w, self.pieces.lookup(strings(w.distinct), self._new_pieces))

    def _in_full(self, texts):
        got = self._whole(strings(texts))
        ids = np.frombuffer(b"".join(got), self.width)
        return ids, np.cumsum([0] + [len(x) // ids.itemsize for x in got])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow string array, and the n + 1 borders between its texts."""
        if not self.by_word:
            return self._in_full(texts)
        easy = simple(texts) if self.by_piece else np.zeros(len(texts), bool)
        if easy.all():
            return self._by_pieces(texts)
        if not easy.any():
            return self._by_words(texts)
        size = np.zeros(len(texts), np.int64)
        parts = []
        for mask, way in ((easy, self._by_pieces), (~easy, self._by_words)):
            ids, borders = way(texts.filter(pa.array(mask)))
            size[mask] = np.diff(borders)
            parts.append((mask, ids))
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]), self.width)
        for mask, ids in parts:
            out[np.repeat(mask, size)] = ids
        return out, np.concatenate(([0], ends))


def encoder(path: str) -> WordEncoder:
    """One encoder (and cache) per Python worker."""
    return worker_cache(("ids", path), lambda: WordEncoder(path))


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as compressed little-endian 16- or 32-bit integers; first byte: bytes per id."""
    ids = ids if ids.dtype.itemsize == 2 else ids.astype("<u4")
    return bytes([ids.dtype.itemsize]) + pa.compress(ids.tobytes(), codec="zstd", asbytes=True) \
        + len(ids).to_bytes(8, "little")


def unpack_ids(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[-8:], "little")
    raw = pa.decompress(blob[1:-8], decompressed_size=n * blob[0], codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(raw, f"<u{blob[0]}").astype("<u4")


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenise(rows: DataFrame, vocabulary: str, end_id: int = END_ID, cuts: tuple[int, ...] = ()) -> DataFrame:
    """One row per document, or per piece: as many of ``cuts[0]`` ids as fit, then of ``cuts[1]``, ..., then the rest.

    ``rows`` has ``row_id, doc_id, text`` (``common.keyed``).  Returns
    ``row_id, doc_id, start, length, doc_tokens, ids`` (packed); every document
    ends with ``end_id``, so an empty text is one id.
    """
    def run(batches):
        enc = encoder(vocabulary)
        for batch in slices(batches, limit=SLICE):
            ids, borders = enc.encode(batch.column("text"))
            rid, did = batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist()
            out = {"row_id": [], "doc_id": [], "start": [], "length": [], "doc_tokens": [], "ids": []}
            for i in range(batch.num_rows):
                own = np.append(ids[borders[i]:borders[i + 1]], ids.dtype.type(end_id))
                at = [0]
                for size in cuts:
                    at += range(at[-1] + size, len(own), size)
                for s, e in zip(at, [*at[1:], len(own)]):
                    for k, v in zip(out, (rid[i], did[i], s, e - s, len(own), pack_ids(own[s:e]))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("row_id", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                 ("doc_tokens", pa.int64()), ("ids", pa.binary())]))
        trim()

    return rows.select("row_id", "doc_id", "text").mapInArrow(
        run, "row_id long, doc_id long, start long, length long, doc_tokens long, ids binary")
