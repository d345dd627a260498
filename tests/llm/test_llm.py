"""Training-data operators against brute force, SQL oracles and odd inputs."""

import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from conftest import SF_ORACLE, SF_SMALL
from flowsieve.llm import (components, exact_dedup, fertility, line_dedup, mixing, ngram_join, packing, quality_model, queries,
                           substring_dedup, token_files, tokens, url_filter)

pytestmark = pytest.mark.filterwarnings("ignore")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, row_id long, n long"
P1 = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = [(0, "same text here " + P1, "en"), (1, "same text here " + P1, None), (1, "same text here " + P1, "en"),
             (2, None, "en"), (3, "", None), (4, "  \n\t ", "xx"), (5, long_text, "en"), (6, long_text + " end", "de"),
             (None, "no key " + P1, "fr"), (None, None, None), (7, "a\nb\nc\nd", "en"), (8, "z\na\nb\nc\nq", "es"),
             (9, "<|endoftext|> İstanbul's \x1c café 漢字 12", "en"), (10, "short", "en")]
    rows = [(k, t, lang, "src0" if k else None, 1, 0.5, True, 5, 9) for k, t, lang in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_ORACLE}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


def test_ids_are_counted_many_texts_at_once(spark, monkeypatch):
    """One count for many short texts (each holds a number per id of the vocabulary), the same totals when cut."""
    class Alone:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return Made(run)

    class Made:
        def __init__(self, run):
            self.run = run

        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return self.run

    rng = np.random.default_rng(4)
    own = [rng.integers(0, 49_000, n).astype("<u2") for n in (3, 0, 50, 1, 2000, 7)]
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([tokens.pack_ids(x) for x in own], pa.binary())})
    want = np.bincount(np.concatenate(own))
    for at_once, most in ((1 << 20, 1), (100, 3)):
        monkeypatch.setattr(token_files, "COUNT_IDS", at_once)
        calls = []
        with monkeypatch.context() as m:
            m.setattr(np, "bincount", lambda *a, f=np.bincount, **k: calls.append(1) or f(*a, **k))
            got, = token_files.id_counts(Alone())(iter([batch]))
        assert got.column("id").to_pylist() == np.flatnonzero(want).tolist()
        assert got.column("n").to_pylist() == want[want > 0].tolist() and len(calls) <= most


def library_ids(text):
    tok = tokens.encoder(tokens.default_vocabulary()).tok
    return np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4")


def test_ids_are_the_librarys(texts):
    enc = tokens.encoder(tokens.default_vocabulary())
    some = [*list(texts.values())[:60], tokens.PROBE, "", " ", "<|endoftext|>x", "don't I'LL", "a\x1cb", "ß É ½ ² ×"]
    ids, at = enc.encode(pa.array(some))
    for i, t in enumerate(some):
        assert list(ids[at[i]:at[i + 1]]) == enc.tok.encode(t, add_special_tokens=False).ids


def test_variable_length_code_round_trip():
    x = (np.random.default_rng(3).integers(0, 1 << 32, 999) >> np.random.default_rng(4).integers(0, 32, 999)).astype("<u4")
    for n in (0, 1, 4, 999):
        assert (token_files.decode_ranks(*token_files.encode_ranks(x[:n]), n) == x[:n]).all()


def test_texts_to_pack_travel_in_small_batches(spark, documents, monkeypatch):
    """Tokenising gets few texts at once, whatever the session allows; the session's setting is back afterwards."""
    key, seen, store = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, packing.store
    monkeypatch.setattr(packing, "store", lambda df, name, *a: seen.update({name: int(spark.conf.get(key))}) or store(df, name, *a))
    before = spark.conf.get(key)
    for allowed, most in (("10000", packing.BATCH_ROWS), ("0", packing.BATCH_ROWS), ("20", 20)):
        spark.conf.set(key, allowed)
        packing.pack(documents.limit(30))
        assert seen == {"pieces": most} and spark.conf.get(key) == allowed
    spark.conf.set(key, before)


def test_token_files_round_trip(spark, documents, odd, empty, texts, tmp_path):
    token_files.write_token_files(documents, f"{tmp_path}/a", block_ids=5000)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, f"{tmp_path}/a").collect()}
    start = 0
    for k in sorted(texts):
        ids = library_ids(texts[k])
        assert (got[k].start, got[k].n_tokens, bytes(got[k].ids)) == (start, len(ids), ids.tobytes())
        start += len(ids)
    token_files.write_token_files(odd, f"{tmp_path}/b")
    rows = sorted(token_files.read_token_files(spark, f"{tmp_path}/b").collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in rows]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:]) and len(rows) == odd.count()
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    token_files.write_token_files(empty, f"{tmp_path}/c")
    assert token_files.read_token_files(spark, f"{tmp_path}/c").count() == 0


def check_packing(pieces, want):
    by_doc = Counter()
    used = {}
    for r in pieces:
        ids = tokens.unpack_ids(bytes(r.ids))
        assert len(ids) == r.length
        by_doc[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc == want
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) <= packing.CAPACITY
    return 1 - sum(want.values()) / (len(used) * packing.CAPACITY)


def test_packing(documents, odd, empty, texts):
    pieces = packing.pack(documents).collect()
    assert check_packing(pieces, {k: len(library_ids(t)) for k, t in texts.items()}) < 0.01
    for k in list(texts)[:80]:
        mine = sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.start)
        assert np.array_equal(np.concatenate([tokens.unpack_ids(bytes(r.ids)) for r in mine]), library_ids(texts[k]))
    want = Counter()
    for r in odd.collect():
        want[r.doc_id] += len(library_ids(r.text or ""))
    check_packing(packing.pack(odd).collect(), want)
    assert packing.pack(empty).count() == 0


def test_column_generation_meets_a_known_optimum():
    # 3 + 3 + 4 fills ten; 7 + 3 fills ten
    plan = packing.whole_patterns(np.array([3, 4, 7]), np.array([300, 100, 100]), 10)
    assert sum(n for n, _ in plan) == 200
    made = Counter()
    for n, pattern in plan:
        for c, k in pattern.items():
            made[c] += n * k
    assert made == {0: 300, 1: 100, 2: 100}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    from tools_oracle import compare
    for sf in (SF_SMALL, SF_ORACLE):
        status, n1, n2, _ = compare(spark, sf, name, queries.QUERIES[name], queries.ORACLES[name])
        assert status == "ok", f"{name}: {status} spark={n1} duck={n2}"


def test_exact_dedup_odd_rows(odd, empty):
    rows = exact_dedup.exact_dedup(odd, width=4, growth=2).collect()
    assert len(rows) == odd.count() and exact_dedup.exact_dedup(empty).count() == 0
    groups = {}
    for r in odd.collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    for r in rows:
        known = [k for k in groups[r.text] if k is not None]
        assert r.group_size == len(groups[r.text]) and r.keep_id == (max(known) if known else None)
    assert Counter(r.text for r in rows if r.kept) == {t: 1 for t in groups}
    assert exact_dedup.drop_copies(odd).columns == odd.columns


def brute_substrings(rows, length):
    """rows in order: (key, bytes)."""
    seen, out = set(), []
    for key, b in rows:
        found = [b[i:i + length] for i in range(len(b) - length + 1)]
        gone = np.zeros(len(b) + 1, int)
        for i, x in enumerate(found):
            if x in seen:
                gone[i] += 1
                gone[i + length] -= 1
        seen.update(found)
        mask = np.cumsum(gone)[:len(b)] > 0
        out.append((key, int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()),
                    bytes(np.frombuffer(b, np.uint8)[~mask])))
    return out


@pytest.mark.parametrize("large,block", [(substring_dedup.LARGE, substring_dedup.BLOCK), (20, 300)])
def test_substring_dedup(documents, texts, large, block):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(documents, large=large, block=block).collect()}
    for k, n, spans, kept in brute_substrings([(k, texts[k].encode()) for k in sorted(texts)], 50):
        assert (got[k].n_removed, len(got[k].starts or ()), bytes(got[k].kept)) == (n, spans, kept)


def test_substring_dedup_odd_rows(odd, empty):
    got = substring_dedup.substring_dedup(odd).collect()
    assert len(got) == odd.count() and substring_dedup.substring_dedup(empty).count() == 0
    assert sorted((r.n_removed for r in got if r.doc_id == 1)) == [len(("same text here " + P1))] * 2
    tail = next(r for r in got if r.doc_id == 6)
    assert 0 < len(bytes(tail.kept)) <= 54


def brute_components(rows, percent=90, n=3):
    sets = []
    for key, text in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        sets.append((key, frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) \
                    and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(s), least.get(find(i))) for i, (k, s) in enumerate(sets) if k is not None)


def near_copies(spark):
    """A family of edited copies, so that frequent shingles fill the prefixes."""
    rng = np.random.default_rng(11)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, len(w)))] = f"e{k}{rng.integers(0, 99)}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(f"u{k}_{i}" for i in range(40)) + " " + " ".join(base[:30])) for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("frequent", [ngram_join.FREQUENT, 10])
def test_ngram_join(spark, frequent):
    docs = near_copies(spark)
    got = ngram_join.ngram_join(docs, frequent=frequent).collect()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_ngram_join_documents_and_odd_rows(spark, odd, empty, documents):
    got = ngram_join.ngram_join(documents).collect()
    want = brute_components([(r.doc_id, r.text or "") for r in documents.collect()])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    got = ngram_join.ngram_join(odd).collect()
    assert len(got) == odd.count() and ngram_join.ngram_join(empty).count() == 0
    want = brute_components([(r.doc_id, r.text or "") for r in odd.collect()])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (50, 3)] + [(99, k) for k in range(100, 160)] + [(k, k + 1) for k in range(200, 230)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[k] for k in (1, 2, 3, 50)} == {1} and got[11] == 10 and got[159] == 99 and got[230] == 200


def test_components_end_at_stars(spark):
    """No further round once every node points to its least one: a star, a chain and a node with two links are told apart."""
    def rest(*links):
        return {r.node for r in components.open_nodes(spark.createDataFrame(links, "u long, v long")).collect()}
    assert rest((2, 1), (3, 1), (9, 8)) == set() and rest((2, 1), (3, 2)) == {2} and rest((3, 1), (3, 2)) == {3}


def test_meetings_shuffle_entries_once(spark):
    rows = [(c, e) for c in range(40) for e in (c % 7, 100 + c, 500 + c // 20)] + [(3, 3), (41, 900), (41, 900)]
    got = ngram_join.meetings(spark.createDataFrame(rows, "cls long, entry long"))
    of = {e: {c for c, k in rows if k == e} for _, e in rows}
    assert sorted((r.cls, r.entry) for r in got.collect()) == sorted({(c, e) for c, e in rows if len(of[e]) > 1})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(entry") and "Broadcast" not in plan


def test_meetings_need_sizes_that_may_link(spark):
    """Classes whose sizes cannot link do not meet; those that can stay in one part of their entry, by loops."""
    rng = np.random.default_rng(12)
    size = {c: int(n) for c, n in enumerate(rng.integers(1, 400, 120))}
    rows = [(c, size[c], int(e)) for c in size for e in rng.integers(0, 25, 4)]
    rows += [(0, size[0], 77), (0, size[0], 77), (500, 100, 900), (501, 112, 900), (502, 500, 901), (503, 450, 901)]
    got = ngram_join.meetings(spark.createDataFrame(rows, "cls long, n long, entry long"), 90)
    size |= {500: 100, 501: 112, 502: 500, 503: 450}

    def pairs(met):
        held = {}
        for c, e in met:
            held.setdefault(e, set()).add(c)
        assert all(len(x) > 1 for x in held.values())
        return {(a, b) for x in held.values() for a in x for b in x if a < b}

    every = {(a, b) for a, _, x in rows for b, _, y in rows if a < b and x == y}
    linkable = {(a, b) for a, b in every if 100 * min(size[a], size[b]) >= 90 * max(size[a], size[b])}
    met = [tuple(r) for r in got.collect()]
    assert len(met) == len(set(met)) and linkable <= pairs(met) < every and (500, 501) not in pairs(met) and (502, 503) in pairs(met)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(entry")


def test_classes_are_not_broadcast(spark):
    """The classes number with the documents: no join of pairs with them passes through the driver."""
    sets = [np.arange(k, k + 300).astype(np.uint64) for k in (0, 3, 900)]
    kinds = spark.createDataFrame([(k, 300, ngram_join.sketch(s).tolist(), ngram_join.sketch(s).tolist()) for k, s in enumerate(sets)],
                                  "cls long, n long, sketch array<long>, folded array<long>")
    got = ngram_join.likely(spark.createDataFrame([(0, 1), (0, 2)], "a long, b long"), kinds, 90)
    assert [(r.a, r.b) for r in got.collect()] == [(0, 1)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_line_dedup(documents, odd, empty, texts):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents).collect()}
    seen = set()
    for k in sorted(texts):
        lines = texts[k].split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(line_dedup.WHITE)]
        gone = set()
        for i in range(len(at) - 2):
            run = tuple(lines[j] for j in at[i:i + 3])
            if run in seen:
                gone.update(at[i:i + 3])
            seen.add(run)
        assert got[k] == "\n".join(x for i, x in enumerate(lines) if i not in gone)
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count() and line_dedup.dedup_lines(empty).count() == 0
    assert next(r.text for r in rows if r.doc_id == 8) == "z\nq"


def brute_long_runs(rows, words, size):
    """Texts by key without later runs of three lines, of one or two long enough, and without later whole texts."""
    seen, out = set(), {}
    for k, text in rows:
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(line_dedup.WHITE)]
        gone = set()
        for n in (1, 2, 3):
            for i in range(len(at) - n + 1):
                run = tuple(lines[j] for j in at[i:i + n])
                if n == 3 or sum(len(WORD.findall(x)) for x in run) >= words or sum(len(x.encode()) for x in run) >= size:
                    if run in seen:
                        gone.update(at[i:i + n])
                    seen.add(run)
        whole = ("whole", *(lines[j] for j in at))
        if 0 < len(at) < 3 and whole in seen:
            gone.update(at)
        seen.add(whole)
        out[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_long_runs(spark, documents, texts, odd, empty):
    for words, size in (line_dedup.LONG, (8, 10_000)):
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents, long_runs=(words, size)).collect()}
        assert got == brute_long_runs(sorted(texts.items()), words, size)
    line, wide = " ".join(f"w{i}" for i in range(60)), "漢字" * 120
    rows = [(0, f"a\n{line}\nb"), (1, line), (2, f"x\n{line}\n{line}\ny"), (3, "two\nshort"), (4, "two\n\nshort"),
            (5, "two"), (6, f"{wide}\nc"), (7, f"d\n{wide}"), (8, "two\nshort\nmore")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, long_runs=line_dedup.LONG).collect()}
    assert got == {**dict(rows), 1: "", 2: "x\ny", 4: "", 7: "d"} == brute_long_runs(rows, *line_dedup.LONG)
    assert line_dedup.dedup_lines(odd, long_runs=line_dedup.LONG).count() == odd.count()
    assert line_dedup.dedup_lines(empty, long_runs=line_dedup.LONG).count() == 0


def test_line_dedup_query_deletes_long_runs(spark, texts):
    import hashlib
    got = {r.doc_id: r.kept_sha256 for r in queries.QUERIES["op7_line_dedup"](spark, SF_ORACLE).collect()}
    want = brute_long_runs(sorted(texts.items()), 50, 600)
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}


def test_quality_rules(documents, odd, empty, texts):
    got = {r.doc_id: r for r in fertility.quality_rules(documents).collect()}
    for k, t in texts.items():
        w = WORD.findall(t)
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        repeated = len({j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated)
        assert r.base_failed == (len(w) < 10 or 100 * repeated > 20 * len(w))
        assert not (r.kept and r.base_failed)
    labelled = [(k, got[k].kept) for k in texts]
    assert sum(x for _, x in labelled) > 0.8 * len(labelled)
    rows = fertility.quality_rules(odd).collect()
    assert len(rows) == odd.count() and fertility.quality_rules(empty).count() == 0
    assert all(r.base_failed for r in rows if r.doc_id in (2, 3, 4, 10))
    assert fertility.drop_rejected(odd).columns == odd.columns


NATURAL = {
    "en": "The committee decided on Tuesday that the old library building should remain open to the public throughout the "
          "winter, although several members pointed out that heating costs have increased considerably. Local residents "
          "welcomed the decision and offered to organise a series of evening events, including readings, concerts and "
          "discussions about the history of the neighbourhood. According to the director, more than three hundred people "
          "visited the reading room during the first week of November, which is twice as many as in the previous year.",
    "de": "Der Ausschuss hat am Dienstag beschlossen, dass die alte Bibliothek auch im Winter für alle geöffnet bleibt, obwohl "
          "einige Mitglieder auf die gestiegenen Heizkosten hingewiesen haben. Die Bewohner des Viertels begrüßten die "
          "Entscheidung und wollen nun Lesungen, Konzerte und Gespräche über die Geschichte der Stadt veranstalten. Nach "
          "Angaben der Leiterin kamen in der ersten Woche im November mehr als dreihundert Menschen in den Lesesaal.",
    "fr": "Le comité a décidé mardi que la vieille bibliothèque resterait ouverte au public pendant tout l'hiver, bien que "
          "plusieurs membres aient rappelé que le chauffage coûte beaucoup plus cher qu'avant. Les habitants du quartier se "
          "sont réjouis de cette décision et proposent d'organiser des lectures, des concerts et des rencontres sur l'histoire "
          "de la ville. Selon la directrice, plus de trois cents personnes sont venues pendant la première semaine de novembre.",
    "es": "El comité decidió el martes que la antigua biblioteca seguirá abierta al público durante todo el invierno, aunque "
          "varios miembros recordaron que la calefacción cuesta mucho más que antes. Los vecinos del barrio celebraron la "
          "decisión y quieren organizar lecturas, conciertos y conversaciones sobre la historia de la ciudad. Según la "
          "directora, más de trescientas personas visitaron la sala durante la primera semana de noviembre.",
}


def test_quality_rules_keep_natural_prose_and_reject_symbol_soup(spark, documents):
    soup = " | ".join(f"{w}###" for w in NATURAL["en"].split()[:12])
    short_bytes = " ".join("ᚠᚢᚦᚨᚱ" for _ in range(2)) + " alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(k, NATURAL[k], k) for k in NATURAL] + [(f"null-{k}", t, None) for k, t in NATURAL.items()]
    rows += [("soup", soup, "en"), ("bytes", short_bytes, "en")]
    docs = spark.createDataFrame([(i, t, lang) for i, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {rows[r.doc_id][0]: r for r in fertility.quality_rules(docs).collect()}
    assert got["en"].chars_per_token > 3 and all(got[k].n_tokens >= fertility.BAND_TOKENS for k in NATURAL)
    assert {k for k, r in got.items() if r.kept} == {*NATURAL, *(f"null-{k}" for k in NATURAL)}
    assert not got["soup"].base_failed and not got["bytes"].base_failed and got["bytes"].n_tokens < fertility.BAND_TOKENS
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet").select("doc_id", "quality")
    judged = fertility.quality_rules(documents).join(labels, "doc_id").filter("not base_failed").collect()
    for quality, least, most in ((0, 0, 0.1), (1, 0.98, 1)):
        kept = [r.kept for r in judged if r.quality == quality]
        assert least <= sum(kept) / len(kept) <= most


def test_quality_model(spark, documents, odd, empty):
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet").selectExpr("doc_id", "quality as label")
    model = quality_model.fit(documents, labels.filter(quality_model.fold() != 1))
    held = quality_model.score(documents, model).join(labels, "doc_id").filter(quality_model.fold() == 1).collect()
    good, bad = [r.score for r in held if r.label == 1], [r.score for r in held if r.label == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(r.score >= 0.5) == (r.label == 1) for r in held]) > 0.95
    rows = quality_model.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.score(empty, model).count() == 0
    blank = quality_model.fit(documents, labels.limit(0))
    assert {r.score for r in quality_model.score(odd, blank).collect()} == {0.5}


def test_mixing_meets_targets_and_odd_rows(odd, empty):
    cells = [(s, lang, "article") for s in ("a", "b") for lang in ("en", "de")]
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.7, "de": 0.3}, "topic": {"article": 1.0}}
    words = np.array([300.0, 300.0, 200.0, 200.0])
    p = mixing.rake(cells, words, targets, rate=0.5)
    share = words * p / (words * p).sum()
    assert abs(share[0] + share[1] - 0.5) < 1e-6 and abs(share[0] + share[2] - 0.7) < 1e-6 and p.max() <= 1
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(empty).count() == 0
    assert mixing.sample(odd).columns == odd.columns


def test_url_filter_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x", "http://example.org/en/12", "http://x.org", "http://x.org/a#b",
            "http://x.com/de/1", "http://x.com/fr/1", "http://xorg/", "http://q.net/a/b/c/d/e/f"]
    bad = [f"http://junk.net/spam/{i}" for i in range(100, 160)] + [f"http://junk.net/fine/{i}" for i in range(200, 260)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls + bad)] + [(0, None, None, None)],
                                  "page_id long, url string, host string, bad long")
    labels = spark.createDataFrame([(i, 1) for i in range(100, 160)] + [(i, 0) for i in range(200, 260)] + [(None, 1)], "number long, bad int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, labels).collect()}
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[5].rule == "example.org/en/1" and got[6].rule is None and got[6].path == "" and got[7].rule == "org/"
    assert got[8].verdict == "block" and got[9].verdict == "allow" and got[10].rule is None
    assert got[0].host == "" and got[0].path == "" and got[11].template.endswith("/**")
    assert {got[i + len(urls)].verdict for i in range(60)} == {"block"} and {got[i + len(urls)].verdict for i in range(60, 120)} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


def test_dedup_stages_judge_rows_not_keys(spark, odd, empty):
    a, x, y, z, w = (" ".join(f"{c}{i}" for i in range(60)) for c in "axyzw")
    rows = [(1, a), (1, a), (None, a), (None, a), (5, x), (5, y), (3, y + " tail"), (None, z), (None, z), (7, None),
            (7, None), (8, ""), (9, w), (9, w), (10, z + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in exact_dedup.drop_copies(docs).collect())
    assert got == Counter([(1, a), (5, x), (5, y), (3, y + " tail"), (None, z), (8, ""), (9, w), (10, z + " tail")])
    got = Counter((r.doc_id, r.text) for r in ngram_join.drop_near_copies(docs).collect())
    assert got == Counter([(1, a), (5, x), (3, y + " tail"), (10, z + " tail"), (7, None), (7, None), (8, ""), (9, w)])
    for drop in (exact_dedup.drop_copies, ngram_join.drop_near_copies):
        assert drop(odd).columns == odd.columns and drop(empty).count() == 0
    assert Counter(r.text or "" for r in exact_dedup.drop_copies(odd).collect()) == {r.text or "": 1 for r in odd.collect()}


def test_pipeline_against_brute_force(spark, texts):
    """Stages 1 to 3 by brute force; the sample and the packed ids by their own counts."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {r.doc_id for r in fertility.quality_rules(docs).filter("kept").collect()}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    last = {}
    for k in sorted(text):
        last[text[k]] = k
    text = {k: t for t, k in last.items()}
    stay = {k: text[k] for k, _, c in brute_components(sorted(text.items()), 80, 5) if k == c}
    left = docs.filter(docs.doc_id.isin(*stay))
    chosen = {r.doc_id for r in mixing.mix_sources(left).filter("selected").collect()}
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    count = Counter()
    for r in got:
        ids = library_ids(stay[r.doc_id])[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
        count[r.doc_id] += r.length
    assert count == {k: len(library_ids(stay[k])) for k in chosen}
    assert [s for s, _ in corpus_pipeline.STAGES][-1] == "packing"


def test_stages_take_odd_rows_and_names(spark, tmp_path):
    """Names that clash with the operators' own, dots, nulls, repeated rows, an empty table: all stages in order."""
    good = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, 2, "a", None) for r in good] * 2
    rows += [(None, good[0].text, None, None, None, None, None, None, 7), (None, None, None, None, 1, 1, 1, "b", 7), (3, "", "en", "src1", 0, 1, 1, "c", 8)]
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", "_gone int", "_row_id int", "`a.b` string", "row int"]
    for k, part in enumerate((rows, [])):
        path = str(tmp_path / f"in{k}" / "documents.parquet")
        spark.createDataFrame(part, ", ".join(names)).repartition(2).write.parquet(path)
        docs = spark.read.parquet(path)
        columns, seen = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs.write.parquet(out := str(tmp_path / f"{k}-{name}")) if name != "quality_rules" else None
            docs = stage(spark, spark.read.parquet(out) if name != "quality_rules" else docs, str(tmp_path / f"in{k}"))
            if name != "packing":
                assert docs.columns == columns and docs.count() <= seen, name
                seen = docs.count()
                if name == "exact_dedup":
                    texts = [r.text or "" for r in docs.collect()]
                    assert len(texts) == len(set(texts))
        assert docs.count() == 0 or k == 0
        assert (k == 0) == (corpus_pipeline.run(spark, str(tmp_path / f"in{k}")).count() > 0)


def test_sketches_never_exceed_the_difference(spark):
    """Sketches of sets of any two sizes, in Python and in the crossing join's expression."""
    rng = np.random.default_rng(8)
    every = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    sets = [np.unique(rng.choice(every, n)) for n in (0, 1, 40, 250, 257, 300, 500, 520, 1000, 1100, 2000, 4000, 8000)]
    pairs = [(i, j, len(np.setxor1d(x, y)), ngram_join.sketch(x).tolist(), ngram_join.sketch(y).tolist())
             for i, x in enumerate(sets) for j, y in enumerate(sets)]
    a, b = (pa.array([p[k] for p in pairs], pa.list_(pa.int64())) for k in (3, 4))
    own = ngram_join.differing(a, b)
    df = spark.createDataFrame(pairs, "i int, j int, d int, sketch_a array<long>, sketch_b array<long>")
    sql = {(r.i, r.j): r.x for r in df.select("i", "j", ngram_join.longer_sketches().alias("x")).collect()}
    for (i, j, d, x, y), bits in zip(pairs, own.tolist()):
        assert bits <= d and sql[i, j] <= d and (i != j or bits == 0)
        assert sql[i, j] == (bits if max(len(x), len(y)) <= 2 * min(len(x), len(y)) else 0)


def test_near_copies_of_five_words(spark):
    """A 200-word text with four scattered words replaced links at five words and 80 %, not at three words and 90 %."""
    words = [f"w{i}" for i in range(200)]
    other = [f"x{i}" if i in (40, 80, 120, 160) else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "quite another text")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3]
    assert ngram_join.drop_near_copies(docs).count() == 3


def test_ftrl_is_the_per_coordinate_loop():
    """Weights and intercept of the quality model against an update of one coordinate at a time."""
    import math
    q = quality_model
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 2)), np.sort(rng.choice(32, 6, replace=False)), rng.random(6)) for _ in range(80)]
    bias, got = q.train_ftrl(rows, 5, 2)
    z, n, zb, nb = [0.0] * 32, [0.0] * 32, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(2):
        for y, at, x in rows:
            w, wb = {int(i): weight(i) for i in at}, -zb / ((q.BETA + math.sqrt(nb)) / q.ALPHA)
            g = 1 / (1 + math.exp(-(wb + sum(w[int(i)] * v for i, v in zip(at, x))))) - y
            for i, v in zip(at, x):
                z[i] += g * v - (math.sqrt(n[i] + (g * v) ** 2) - math.sqrt(n[i])) / q.ALPHA * w[int(i)]
                n[i] += (g * v) ** 2
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / q.ALPHA * wb
            nb += g * g
    assert np.allclose(got, [weight(i) for i in range(32)]) and abs(bias + zb / ((q.BETA + math.sqrt(nb)) / q.ALPHA)) < 1e-9


COLUMNS = {
    "op1": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op2": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op3": ["doc_id", "held_out", "score", "predicted"],
    "op5": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6": ["doc_id", "n_shingles", "component_id"],
    "op8": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_registered_queries_give_a_row_for_every_document(spark, op):
    name = next(k for k in queries.QUERIES if k.split("_")[0] == op)
    out = queries.QUERIES[name](spark, SF_SMALL)
    assert out.columns[:len(COLUMNS[op])] == COLUMNS[op]
    docs = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id").collect()}
    got = [r.doc_id for r in out.select("doc_id").collect()]
    assert set(got) == docs and (op == "op1" or len(got) == len(docs))


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    for p in root.glob("flowsieve/**/*.py"):
        if "llm" not in p.parts:
            assert "llm" not in re.findall(r"import .*|from .*", p.read_text()).__str__(), p
