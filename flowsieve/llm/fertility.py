"""Quality rules: plain counts, and how a public vocabulary takes a text apart.

Every whole text is measured with a vocabulary that falls back to bytes:
``chars_per_token`` (fertility), ``byte_share`` (tokens that are single bytes)
and ``token_entropy`` (bits, of the text's own token distribution).  Clean text
of a language stays within a band of each; text in another encoding, symbol
soup, shouting and loops leave it.  Bands are given per language, and for an
unknown or null language per script, found from the text's letters.  Shares of
bytes and of symbols (per word) are judged at any length, the others from
``BAND_TOKENS`` tokens on.

The vocabulary never merges across white space, so a worker asks it once per
word and keeps the answer in a bounded cache.

Edge cases: null text has no words and no lines; a text without words has
fertility 0 and fails the base rules; a null or unlisted language takes its
script's band, and a script without a band the widest one; one row comes out
for every row in, also for repeated rows; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import TwoAges, Words, mix, segment_sums, slices, trim, utf8, whole_row, worker_cache

VOCABULARY = "piece_bpe_32k.model"
WHITE = " \t\n\r\x0b\f"
#: Text measured at once inside a task.
SLICE = 1 << 20
SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1

#: Words of a repeated window, and the base limits of the rules.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20

#: language or script: (least and most characters per token, most byte share, least entropy in bits).
#: Lower limits are those of invented prose (about 2 characters per token); natural prose has 3 to over 5, so the
#: upper limits lie beyond what the vocabulary gives words of a Latin script.
BANDS = {
    "en": (1.85, 8.0, 0.02, 4.5),
    "de": (1.80, 8.0, 0.02, 4.5),
    "fr": (1.65, 8.0, 0.02, 4.5),
    "es": (1.68, 8.0, 0.02, 4.5),
    "latin": (1.50, 8.0, 0.05, 4.0),
    "other": (0.20, 8.0, 0.95, 2.0),
}
#: Fertility and entropy count from this many tokens on; of a shorter text they say little.
BAND_TOKENS = 64
#: Most symbols per hundred words.
MAX_SYMBOL_PERCENT = 30

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_tokens long, chars_per_token double, byte_share double, token_entropy double, band string")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


class PieceCounter:
    """Token ids of words, cached; which ids are single bytes."""

    def __init__(self, path: str, capacity: int = 100_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.IsByte(i) for i in range(self.model.GetPieceSize())])
        self.words = TwoAges(capacity)

    def _new(self, words: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.model.encode(words, num_threads=1)]

    def ids(self, words: list[str]) -> list[bytes]:
        return self.words.lookup(words, self._new)


def counter(path: str) -> PieceCounter:
    return worker_cache(("pieces", path), lambda: PieceCounter(path))


def repeated_words(w: Words, width: int = WINDOW) -> np.ndarray:
    """Per document: words inside windows of ``width`` words that occur twice or more in it."""
    n = len(w.codes)
    covered = np.zeros(n + 1, np.int64)
    start = np.flatnonzero(w.within(width))
    if len(start):
        code = mix(w.codes.astype(np.uint64) + np.uint64(1))
        key = mix(w.document_of_word()[start].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for k in range(width):
            key = mix(key ^ code[start + k]) + np.uint64(k)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = start[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + width, -1)
    return segment_sums(np.cumsum(covered)[:n] > 0, w.offsets)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def entropies(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the token distribution of each segment."""
    out = np.zeros(len(offsets) - 1)
    size = np.diff(offsets)
    if len(ids):
        key = np.repeat(np.arange(len(size), dtype=np.int64) << 32, size) | ids.astype(np.int64)
        key.sort()
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(edge, len(key)))
        doc = key[edge] >> 32
        share = count / size[doc]
        out += np.bincount(doc, -share * np.log2(share), len(size))
    return out


def bands_of(texts, langs: list, bands: dict) -> list[str]:
    """The language's band if it has one, else that of the script of most letters."""
    out = []
    for text, lang in zip(texts, langs):
        name = (lang or "").strip().lower()
        if name not in bands or name in ("latin", "other"):
            letters = [c for c in text.as_py() if c.isalpha()]
            name = "latin" if 2 * sum(c < "ɐ" for c in letters) >= len(letters) else "other"
        out.append(name)
    return out


def measure(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text",
            lang: str = "lang", bands: dict | None = None, carry: bool = False) -> DataFrame:
    """Counts and token measures of every row; see ``SCHEMA``.  ``carry`` adds the whole input row as ``row``."""
    vocabulary, bands = vocabulary or default_vocabulary(), bands or BANDS

    def read(batches):
        """The text of a carried row is taken from the row, not sent twice."""
        for b in batches:
            if carry:
                own = pc.fill_null(pc.struct_field(b.column("row"), [text]), "")
                b = pa.RecordBatch.from_arrays([*b.columns, own], [*b.schema.names, "text"])
            yield b

    def run(batches):
        c = counter(vocabulary)
        for b in slices(read(batches), limit=SLICE):
            texts = b.column("text")
            w = Words(texts)
            known = c.ids(w.distinct.to_pylist())
            flat = np.frombuffer(b"".join(known), "<u4")
            size = np.fromiter(map(len, known), np.int64, len(known)) // 4
            first = np.cumsum(size) - size
            byte = segment_sums(c.is_byte[flat], np.concatenate((first, [len(flat)])))
            per_word = size[w.codes]
            ends = np.concatenate(([0], np.cumsum(per_word)))
            at = np.repeat(first[w.codes] - ends[:-1], per_word) + np.arange(ends[-1])
            offsets = ends[w.offsets]
            chars = segment_sums(pc.utf8_length(w.distinct).to_numpy(zero_copy_only=False)[w.codes], w.offsets)
            n_tokens = np.diff(offsets)
            least = np.maximum(n_tokens, 1)
            raw, borders = utf8(texts)
            yield pa.RecordBatch.from_pydict({
                **({"row": b.column("row")} if carry else {}),
                "doc_id": b.column("doc_id"),
                "n_words": pa.array(np.diff(w.offsets), pa.int64()),
                "word_chars": pa.array(chars, pa.int64()),
                "n_symbols": pa.array(segment_sums(SYMBOL[raw], borders), pa.int64()),
                "n_dup_lines": pa.array([duplicate_lines(t.as_py()) for t in texts], pa.int64()),
                "n_repeat_words": pa.array(repeated_words(w), pa.int64()),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "chars_per_token": pa.array(chars / least, pa.float64()),
                "byte_share": pa.array(segment_sums(byte[w.codes], w.offsets) / least, pa.float64()),
                "token_entropy": pa.array(entropies(flat[at], offsets), pa.float64()),
                "band": pa.array(bands_of(texts, b.column("lang").to_pylist(), bands), pa.string())})
        trim()

    language = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    row = [whole_row(docs).alias("row")] if carry else []
    content = [] if carry else [F.coalesce(F.col(text), F.lit("")).alias("text")]
    rows = docs.select(*row, F.col(key).cast("long").alias("doc_id"), *content, language.alias("lang"))
    out = StructType.fromDDL(SCHEMA)
    return rows.mapInArrow(run, StructType([rows.schema["row"], *out.fields]) if carry else out)


def judge(measured: DataFrame, bands: dict | None = None, min_words: int = MIN_WORDS,
          max_repeat_percent: int = MAX_REPEAT_PERCENT, band_tokens: int = BAND_TOKENS,
          max_symbol_percent: int = MAX_SYMBOL_PERCENT) -> DataFrame:
    """Adds ``base_failed`` (too short, or loops), ``in_band`` and ``kept``."""
    bands = bands or BANDS

    def limit(k: int):
        widest = (min if k in (0, 3) else max)(b[k] for b in bands.values())
        table = F.create_map(*[F.lit(x) for name, b in bands.items() for x in (name, float(b[k]))])
        return F.coalesce(F.element_at(table, F.col("band")), F.lit(float(widest)))

    at_any_length = ((F.col("byte_share") <= limit(2))
                     & (100 * F.col("n_symbols") <= max_symbol_percent * F.col("n_words")))
    in_band = at_any_length & ((F.col("n_tokens") < band_tokens) | (
        F.col("chars_per_token").between(limit(0), limit(1)) & (F.col("token_entropy") >= limit(3))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (measured.withColumn("base_failed", failed).withColumn("in_band", in_band)
            .withColumn("kept", ~F.col("base_failed") & F.col("in_band")))


def quality_rules(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text",
                  lang: str = "lang", bands: dict | None = None, **limits) -> DataFrame:
    """Measures and verdict of every row."""
    return judge(measure(docs, vocabulary, key, text, lang, bands), bands, **limits)


def drop_rejected(docs: DataFrame, **rules) -> DataFrame:
    """``docs`` without the rows that the rules reject, columns as they were; one narrow pass."""
    judged = judge(measure(docs, carry=True, **rules), rules.get("bands"))
    return judged.filter("kept").select("row.*")
