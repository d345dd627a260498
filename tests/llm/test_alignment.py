"""Cross-tokenizer alignment against a plain walk over bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL
from flowsieve.llm import alignment as al
from flowsieve.llm import queries

SCHEMA = "doc_id long, text string, n_a string, row_id long, pairs string, groups int"


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    path_a, path_b = al.default_vocabularies()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=path_b), {c: b for c, b in al.byte_letters().items()}


def tokens_of(libraries, text):
    """Ids and ends of both vocabularies, from one call for the whole text; None without tokens."""
    a, b, letters = libraries
    if not text:
        return None
    raw = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in ids_b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    return ids_a, ids_b, np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()


def by_hand(libraries, texts):
    """Result rows (without key) of a list of texts."""
    docs, count = [], Counter()
    for t in texts:
        got = tokens_of(libraries, t)
        if got is None:
            docs.append(None)
            continue
        ids_a, ids_b, ends_a, ends_b = got
        common = sorted(set(ends_a) & set(ends_b))
        groups = [([i for i, e in zip(ids_a, ends_a) if lo < e <= hi], [i for i, e in zip(ids_b, ends_b) if lo < e <= hi])
                  for lo, hi in zip([0, *common], common)] if len(common) < 400 else None
        if groups is None:
            groups, i, j = [], 0, 0
            for hi in common:
                i0, j0 = i, j
                while i < len(ends_a) and ends_a[i] <= hi:
                    i += 1
                while j < len(ends_b) and ends_b[j] <= hi:
                    j += 1
                groups.append((ids_a[i0:i], ids_b[j0:j]))
        links, i, j = [], 0, 0
        for end in sorted(set(ends_a) | set(ends_b)):
            links.append((ids_a[i], ids_b[j]))
            i += ends_a[i] == end
            j += ends_b[j] == end
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(written.encode()).hexdigest()))
        count.update(set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (d[0], d[1], d[2], len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]), d[4])
            for d in docs]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  ", "\n", "foo ", " foo", "a  b\t\tc \n d", "\nfoo\r\n bar;\r", "<|endoftext|> <s> </s> <0x41> <unk>",
       "a▁b", "▁", "naïve café — “quoted”… 漢字 かな", "x　y z", "a\x00b\x1c c", "🙂🙂 👩‍👩‍👧", "it's we'll I'M",
       "x" * 5000, "  lead", "tail \n", "é ﬁ Ⅷ", " line", "1234567890 12 3.14"]


def test_runs_and_groups_of_random_ends():
    rng = random.Random(1)
    for total in (1, 2, 7, 60, 900):
        for share in (0.1, 0.5, 0.95):
            a = sorted({total, *(e for e in range(1, total) if rng.random() < share)})
            b = sorted({total, *(e for e in range(1, total) if rng.random() < 0.7 or e in a and share > 0.9)})
            runs, odd, la, lb = al.skip_runs(np.array(a), np.array(b))
            spans = sorted([(i + k, j + k, i + k + 1, j + k + 1) for i, j, n in runs.tolist() for k in range(n)]
                           + [tuple(x) for x in odd.tolist()])
            assert [a[s[2] - 1] for s in spans] == sorted(set(a) & set(b)) == [b[s[3] - 1] for s in spans]
            links = sorted([(i + k, j + k) for i, j, n in runs.tolist() for k in range(n)] + list(zip(la.tolist(), lb.tolist())))
            lo = lambda ends, i: ends[i - 1] if i else 0
            assert links == [(i, j) for i in range(len(a)) for j in range(len(b))
                             if max(lo(a, i), lo(b, j)) < min(a[i], b[j])]


def test_ids_are_the_libraries(libraries):
    enc = al.encoders(*al.default_vocabularies())
    assert enc.cuts
    some = [t or "" for t in ODD]
    a, at_a, b, at_b = enc.encode(pa.array(some))
    for i, t in enumerate(some):
        whole = tokens_of(libraries, t)
        got = (a[at_a[i]:at_a[i + 1]].tolist(), b[at_b[i]:at_b[i + 1]].tolist())
        assert got == ((whole[0], whole[1]) if whole else ([], [])), t


@pytest.mark.parametrize("frequent", [al.FREQUENT, 25, 0])
def test_odd_rows(spark, libraries, frequent):
    texts = [*ODD, *ODD[5:9], "the cat sat on the mat", "the cat sat", "w" + " word" * 3000, "the cat sat"]
    keys = [None if i % 7 == 3 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(k, t, "x", 3, "y", 1) for k, t in zip(keys, texts)], SCHEMA).repartition(4)
    got = al.alignment(df, frequent=frequent).select(COLUMNS).collect()
    want = [(k, *row) for k, row in zip(keys, by_hand(libraries, texts))]
    assert Counter(map(tuple, got)) == Counter(want)


def test_empty_table(spark):
    assert al.alignment(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_whole_table(spark, libraries):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_alignment"](spark, SF_SMALL)
    assert got.columns == COLUMNS
    want = [(r.doc_id, *x) for r, x in zip(rows, by_hand(libraries, [r.text for r in rows]))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
