"""The corpus operators against brute force, on the smallest tables and on odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import decontam, jaccard_join, langid, licenses, lm, packing, quality, sharding, token_orc, tokens, voronoi, warc
from sluice.llm.common import Workspace
from sluice.llm.elias_fano import EliasFano, from_buffer, to_bytes
from sluice.llm.queries import default_tokenizer
from sluice.llm.tokens import WordEncoder

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 8000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text here for all of them now yes it is"), (5, "same text here for all of them now yes it is"), (6, LONG), (None, "no id at all but ten words are in this text ok"), (7, "ÉÀ ß İ 中文 <|endoftext|> \x1c x")]
WS, AL = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in ODD], "doc_id long, text string, key string, n long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=300).map(sorted), st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_elias_fano(values, asked):
    v = np.array(values, np.uint64)
    e = EliasFano.of(from_buffer(to_bytes(EliasFano.encode(v).arrays("x"))), "x")
    q = np.array(asked + values, np.uint64)
    assert e.decode().tolist() == values if len(v) else e.n == 0
    assert [(i >= 0) for i in e.find(q)] == [x in set(values) for x in q.tolist()]


def test_encoder_is_the_library(texts):
    e = WordEncoder.of(default_tokenizer())
    sample = [*texts.values(), *(t for _, t in ODD)]
    want = [np.array(e.whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for t in sample]
    assert e.encode(sample) == want


def test_encoder_of_all_characters_and_little_memory(monkeypatch):
    """Every rule for pieces meets every character that is taken apart outside the library, and some beyond; texts are
    split over ranges, and words are forgotten between them."""
    path = default_tokenizer()
    chars = [*map(chr, range(0x260)), *"\u0301\u0345\u03a3\u03c2\u0416\u1e9e\u2028\u212b\u3000\u4e2d\u0e01\ufb01\U0001d400\U0001f600"]
    sample = [x for c in chars for x in (c, f"A{c}B {c}{c}1{c} it{c}'S {c}'ll,{c}\n..{c}", f" {c}", f"{c} ")]
    sample += [None, "", " ", "word " * 3000, "Ab,c" * 2000, "<|endoftext|> a", "a <| b", "x\x1cy z", "I'M you'Ve 12345 a--b \"''s\""]
    whole = WordEncoder(path).whole
    want = [np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for t in sample]
    assert WordEncoder(path).encode(sample) == want
    for name, value in (("CHUNK", 500), ("COPIED", 7), ("MAX_WORDS", 5), ("MAX_PIECES", 20), ("BATCH", 3)):
        monkeypatch.setattr(tokens, name, value)
    small = WordEncoder(path)
    assert small.encode(sample) == want and small.encode(sample[::-1]) == want[::-1]
    foreign = WordEncoder(path)
    foreign.foreign = ""  # as by a rule for pieces that isn't known here
    assert foreign.encode(sample[::5]) == want[::5]
    assert small.encode([]) == []


def test_encoder_looks_words_up_once():
    """Words that fill many texts are looked up once for all of them, not at each place."""
    looked = []

    class Seen(dict):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    e = WordEncoder(default_tokenizer())
    e.words, e.pieces = Seen(e.words), Seen(e.pieces)
    words = [f"{chr(97 + i // 10)}word{chr(97 + i % 10)}" for i in range(50)]
    coded = e.encode([" ".join(words[(i * k) % 50] for k in range(400)) for i in range(250)])
    assert len(coded) == 250 and 0 < len(looked) < 500


def brute_components(texts, n, percent):
    def shingles(t):
        w = WS.findall(low(t))
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for a, (i, s) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(sets)) if find(b) == find(a) and sets[b][0] is not None]
        out.append((i, len(s), min(ids, default=None) if s else i))
    return sorted(out, key=str)


def force_recursion(monkeypatch):
    """Keys are hot from the third row on, and regions of more than three documents are re-centred."""
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "MAX_MEMBERS", 3)


@pytest.mark.parametrize("n,percent,forced", [(3, 90, False), (3, 90, True), (5, 80, False), (5, 80, True)])
def test_jaccard(spark, docs, texts, n, percent, forced, monkeypatch):
    if forced:
        force_recursion(monkeypatch)
    got = jaccard_join.jaccard_components(docs, Workspace(spark, "t"), n, percent).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(list(texts.items()), n, percent)


def test_jaccard_of_near_copies(spark, monkeypatch):
    """Copies of one text with random edits: similarities on both sides of the threshold."""
    force_recursion(monkeypatch)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.integers(0, 6)):
            words[rng.integers(0, 120)] = f"e{rng.integers(0, 60)}"
        rows.append((i, " ".join(words[: 120 - int(rng.integers(0, 3))])))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, ["doc_id", "text"]), Workspace(spark, "t"), 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 90)


def test_keep_one_with_clashing_columns(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(2, text, 1, "g", {"m": 1}), (1, text + " z", 2, "g", {"m": 2}), (1, text + " z", 3, None, None), (None, text, 4, "x", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, `group` string, row map<string,int>")
    kept = jaccard_join.keep_one(docs, Workspace(spark, "t"))
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.id) for r in kept.collect()) in ([(False, 2), (True, 4)], [(False, 3), (True, 4)])


def test_region_joins_like_brute_force():
    """Voronoi cells, windows and rings connect what all pairs within the threshold connect, and nothing else."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        percent, bases, sets = int(rng.choice([90, 80, 50])), [rng.integers(0, 1 << 60, rng.integers(5, 60)) for _ in range(rng.integers(1, 6))], []
        for _ in range(rng.integers(2, 80)):
            base = bases[rng.integers(0, len(bases))]
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0, 0.02, 0.05, 0.1, 0.2])], rng.integers(0, 40, rng.integers(1, 4))])))
        label = list(range(len(sets)))

        def joined(pairs):
            for a, b in pairs:
                x, y = label[a], label[b]
                label[:] = [min(x, y) if v in (x, y) else v for v in label]
            return list(label)

        near = [(a, b) for a in range(len(sets)) for b in range(a) if (c := len(np.intersect1d(sets[a], sets[b]))) * 100 >= percent * (len(sets[a]) + len(sets[b]) - c)]
        links = voronoi.Region(sets, percent).join()
        assert {(max(x), min(x)) for x in links} <= set(near)
        got = joined(links)
        label = list(range(len(sets)))
        assert got == joined(near)


def test_cells_merge_in_a_tree(spark):
    """Counts of all shingles, whatever the number of tasks."""
    rows = [(i, f"a b c d{i % 7}") for i in range(150)]
    want = Counter(int(c) % (1 << 16) for _, t in rows for c in jaccard_join.shingle_set(t.encode(), 2))
    for tasks in (1, 130):
        got = jaccard_join.shingle_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks), 2, 1 << 16)
        assert {i: int(got[i]) for i in np.flatnonzero(got)} == dict(want)


def test_jaccard_recentred_for_the_pipeline(spark, monkeypatch):
    """The second recursion runs at the pipeline's parameters: near copies around 80 % on five-word shingles."""
    force_recursion(monkeypatch)
    runs, recentred = [], jaccard_join._recentred

    def counted(cells, percent):
        runs.append((percent, cells.count()))
        return recentred(cells, percent)

    monkeypatch.setattr(jaccard_join, "_recentred", counted)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.integers(0, 5)):
            words[rng.integers(0, 120)] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(words[: 120 - int(rng.integers(0, 3))])))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, ["doc_id", "text"]), Workspace(spark, "t"), 5, 80).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 5, 80)
    assert any(percent == 80 and n > 0 for percent, n in runs)


def test_jaccard_odd(spark, odd, none):
    got = jaccard_join.jaccard_components(odd, Workspace(spark, "t")).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(ODD, 3, 90)
    assert jaccard_join.jaccard_components(none, Workspace(spark, "t")).count() == 0
    kept = jaccard_join.keep_one(odd, Workspace(spark, "t"))
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, None]))


def test_keep_one_tells_texts_of_one_id_apart(spark):
    """Rows that share a doc_id with a copy of something else, or with an unrelated text, are copies of nothing."""
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(3, text("a")), (7, text("a") + " z"), (7, text("b")), (5, text("x")), (5, text("y")), (9, text("p")), (9, text("p") + " z"), (9, text("q")), (9, text("q")), (8, ""), (8, None), (8, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()
    want = [(3, text("a")), (7, text("b")), (5, text("x")), (5, text("y")), (9, text("p")), (9, text("q")), (8, ""), (8, None)]
    assert Counter(map(tuple, kept)) == Counter(want)


def test_a_long_list_of_copies_is_broadcast(spark, monkeypatch):
    """So many copies as 6 GB hold: whole texts are neither shuffled nor sorted to drop them."""
    found = spark.range(400_000).selectExpr("id AS doc_id", "-1L AS component_id", "xxhash64('a') AS text_key", "0L AS root")
    monkeypatch.setattr(jaccard_join, "jaccard_components", lambda *a, **k: found)
    docs = spark.createDataFrame([(7, "a"), (7, "b"), (400_000, "a"), (None, "a")], "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard_join.keep_one(docs, Workspace(spark, "t"))
        assert sorted(map(tuple, kept.collect()), key=str) == [(400_000, "a"), (7, "b"), (None, "a")]
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_packing_and_orc(spark, docs, odd, none, tmp_path):
    e = WordEncoder.of(default_tokenizer())
    for frame in (docs, odd):
        rows = sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        ids = [b for b in e.encode([t for _, t in rows])]
        want = Counter((d, len(b) // 4, zlib.crc32(b)) for (d, _), b in zip(rows, ids))
        token_orc.write_tokens(frame, f"file://{tmp_path}/orc", default_tokenizer())
        got = token_orc.digests(spark, f"file://{tmp_path}/orc").collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        ordered = sorted(got, key=lambda r: r.start)
        assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered[:-1])]).tolist()
        assert [r.doc_id for r in ordered] == [d for d, _ in rows]
        pieces = packing.pack(frame, Workspace(spark, "t"), default_tokenizer(), size=512).collect()
        by_doc, by_sequence = Counter(), {}
        for p in pieces:
            by_doc[p.doc_id] += p.length
            by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert by_doc == Counter({d: sum(len(b) // 4 for (x, _), b in zip(rows, ids) if x == d) for d, _ in rows})
        for s in by_sequence.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 512
    assert packing.pack(none, Workspace(spark, "t"), default_tokenizer()).count() == 0


def test_packing_takes_few_rows_at_once(spark, monkeypatch):
    """A task holds its batches beside the encoder, so their rows and the bytes taken apart at once are bounded."""

    class Spy:
        @staticmethod
        def of(path):
            return Spy()

        def runs(self, texts, chunk=8 << 20):
            assert len(texts) <= 100 and chunk <= 4 << 20
            return WordEncoder.of(default_tokenizer()).runs(texts, chunk)

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    table = spark.range(450).selectExpr("id AS doc_id", "repeat('word ', 1 + id % 7) AS text").coalesce(1)
    before = spark.conf.get(key)
    whole = packing.pack(table, Workspace(spark, "p"), default_tokenizer()).orderBy("doc_id").collect()
    monkeypatch.setattr(packing, "WordEncoder", Spy)
    monkeypatch.setattr(packing, "BATCH_ROWS", 100, raising=False)
    assert packing.pack(table, Workspace(spark, "p"), default_tokenizer()).orderBy("doc_id").collect() == whole
    assert len(whole) == 450 and spark.conf.get(key) == before


def test_encoder_copies_few_words_at_once():
    """Beside what it returns, copying the ids of many words takes little memory."""
    import tracemalloc

    ids, starts, sizes = np.arange(100, dtype="<u4"), np.arange(1_000_000) % 98, np.full(1_000_000, 2)
    tracemalloc.start()
    try:
        copied = tokens._copied(ids, starts, sizes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (copied.reshape(-1, 2) == np.stack([starts, starts + 1], 1)).all()
    assert peak < 3 * copied.nbytes


def test_packing_in_the_query(spark, docs, odd):
    """Each id lies in exactly one piece, and the pieces' digests are those of the documents' own ids."""
    e = WordEncoder.of(default_tokenizer())
    long = odd.select("doc_id", "text").union(spark.createDataFrame([(50, "lorem ipsum dolor sit amet " * 20_000), (51, "a " * 4095), (52, "a " * 4096)], "doc_id long, text string"))
    for frame in (docs, long):
        ids = Counter()
        for r in frame.collect():
            ids[r.doc_id, e.encode([r.text])[0]] += 1
        pieces = packing.pack(frame, Workspace(spark, "t"), default_tokenizer()).collect()
        made, sequences = {}, {}
        for p in pieces:
            made.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32, p.doc_tokens))
            sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        want = {}
        for (doc, data), times in ids.items():
            n = len(data) // 4
            cuts = range(0, n, 4096)
            want.setdefault(doc, []).extend([(s, min(4096, n - s), zlib.crc32(data[4 * s : 4 * min(n, s + 4096)]), n) for s in cuts] * times)
        assert {d: sorted(x) for d, x in made.items()} == {d: sorted(x) for d, x in want.items()}
        for s in sequences.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 4096


def test_orc_is_pruned_by_its_index(spark, docs, none, tmp_path):
    """Files have statistics and Bloom filters on doc_id; a lookup reads fewer rows, and nothing for an id between."""
    import pyarrow.orc

    path = f"file://{tmp_path}/orc"
    many = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    token_orc.write_tokens(many, path, default_tokenizer())
    folder = str(tmp_path / "orc")
    parts = [pyarrow.orc.ORCFile(f"{folder}/{f}") for f in __import__("os").listdir(folder) if f.startswith("part-")]
    assert len(parts) > 1 and sum(p.nrows for p in parts) == 20_000 and all(p.row_index_stride == 1000 and p.compression == "ZSTD" for p in parts)

    def scanned(doc_id):
        found = token_orc.read_tokens(spark, path).filter(F.col("doc_id") == doc_id)
        n, scan = len(found.collect()), found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return n, scan.metrics().get("numOutputRows").get().value()

    hit, miss, outside = scanned(20_000), scanned(20_001), scanned(10**9)
    assert hit[0] == 1 and hit[1] <= 3000 and miss[0] == 0 and miss[1] <= hit[1] and outside == (0, 0)
    token_orc.write_tokens(none, f"{path}-none", default_tokenizer())
    assert token_orc.read_tokens(spark, f"{path}-none").count() == 0 and token_orc.digests(spark, f"{path}-none").count() == 0


def test_cutting_stock_is_near_the_linear_program():
    rng = np.random.default_rng(0)
    demand = rng.integers(0, 40, 64)
    plan = packing.plan(demand, 64)
    assert sum(p * n for p, n in plan).tolist() == demand.tolist()
    assert all(p @ np.arange(1, 65) <= 64 for p, _ in plan)
    least = packing.solve(demand, 64)[1].sum()  # no packing has fewer sequences than the linear program
    assert least >= demand @ np.arange(1, 65) / 64 - 1e-6
    assert sum(n for _, n in plan) <= math.ceil(least) * 1.02 + 2


def brute_licenses(index, words):
    """(label, place) and scores, by trying every beginning of every template against all of a text's words."""
    out, scores = set(), [0.0]
    for t in index.templates:
        held = [w for w in sorted(set(t.words), key=lambda w: (-index.weight.get(w, 0.0), w)) if w in words]
        asked = held if t.base else held[: licenses.RARE]
        need = len(set(t.words)) if t.base else min(licenses.AGREE, len(asked))
        wide = 0 if t.base else licenses.TOLERANCE
        near = lambda begin, w: any(t.words[k] == w and words[i] == w for k in range(len(t.words)) for i in range(max(0, begin + k - wide), min(len(words), begin + k + wide + 1)))  # noqa: B023, E731
        for place in range(len(words) - len(t.phrase) + 1):
            begin = place - t.start
            if words[place : place + len(t.phrase)] == t.phrase and asked and sum(near(begin, w) for w in asked) >= need:
                out.add((t.label, place))
                weigh = [index.weight.get(w, 0.0) + 1e-9 for w in t.words]
                here = sum(v for k, (w, v) in enumerate(zip(t.words, weigh)) if w in words[max(0, begin + k - wide) : max(0, begin + k + wide + 1)])
                scores.append(here / sum(weigh))
    return out, max(scores)


def test_licenses_against_brute_force(spark):
    """Whole licences, with words put in, left out or changed, and loose licence words."""
    rng = np.random.default_rng(6)
    texts = ["MIT License. mit license apache license", "general public license", "license mit"]
    for label, key, text in licenses.TEMPLATES:
        w = text.split()
        texts += [text, text.upper(), key, " ".join(w[: len(w) // 2])]
        for _ in range(2):
            changed = [x for x in w if rng.random() > 0.05]
            for _ in range(3):
                changed.insert(int(rng.integers(0, len(changed) + 1)), "zzz")
            texts.append("Intro words here. " + " ".join(changed) + " The end, of the software.")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    _, weight = licenses.document_frequencies(docs, licenses.vocabulary(licenses.BASE, licenses.TEMPLATES))
    index = licenses.Index(licenses.BASE, licenses.TEMPLATES, weight)
    for i, t in enumerate(texts):
        places, score = brute_licenses(index, licenses.words_of(t.encode()))
        assert {(p.label, p.word) for p in got[i].places} == places and got[i].labels == ",".join(sorted({x for x, _ in places})), t
        assert got[i].score == pytest.approx(min(1.0, score))
    named = {label: [got[i].labels.split(",") for i, t in enumerate(texts) if t == text] for label, _, text in licenses.TEMPLATES}
    assert all(label in x for label, rows in named.items() for x in rows)


def test_licenses(docs, texts, odd, none):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for d, t in texts.items():
        w = AL.findall(low(t))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0


def test_language(docs, odd, none):
    told = langid.identify(docs, docs.filter(~langid.held_out())).filter(langid.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in told) >= 0.95 * len(told)
    out = langid.identify(odd, docs)
    assert out.columns == [*odd.columns, "lang_pred", "lang_score"]
    assert {r.doc_id for r in out.collect() if r.lang_pred == "und"} == {1, 2, 3}
    assert langid.identify(none, docs).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, docs.limit(0)).collect()} == {"und"}


def plain_fit(examples, idf):
    """Follow the regularised leader by the book, one weight at a time."""
    labels = sorted({lang for lang, _, _ in examples})
    used = [e for e in examples if zlib.crc32(e[1].tobytes() + e[2].tobytes(), 7) % 5] or examples
    l1, l2, z, n = langid.L1 * len(used), langid.L2 * len(used), {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= l1:
            return 0.0
        return -(z[key] - math.copysign(l1, z[key])) / ((langid.BETA + math.sqrt(n[key])) / langid.ALPHA + l2)

    for _ in range(langid.EPOCHS):
        for lang, at, counts in used:
            x = {int(b): (1 + math.log(c)) * idf[b] for b, c in zip(at, counts)}
            length = math.sqrt(sum(v * v for v in x.values()))
            x = {**{b: v / length for b, v in x.items()}, len(idf): 1.0}
            w = {(b, k): weight((b, k)) for b in x for k in range(len(labels))}
            scores = [sum(v * w[b, k] for b, v in x.items()) for k in range(len(labels))]
            e = [math.exp(v - max(scores)) for v in scores]
            for b, v in x.items():
                for k in range(len(labels)):
                    g = v * (e[k] / sum(e) - (labels[k] == lang))
                    sigma = (math.sqrt(n.get((b, k), 0.0) + g * g) - math.sqrt(n.get((b, k), 0.0))) / langid.ALPHA
                    z[b, k] = z.get((b, k), 0.0) + g - sigma * w[b, k]
                    n[b, k] = n.get((b, k), 0.0) + g * g
    return labels, {key: weight(key) for key in z}


def test_language_model_by_the_book(docs, texts):
    """Weights equal those of a plain implementation, document frequencies those of a count, and some weights are struck."""
    training = docs.filter("lang IS NOT NULL").limit(60).cache()
    idf = langid.inverse_frequencies(training)
    seen = Counter(int(b) for r in training.collect() if langid.has_letter(r.text) for b in langid.features(r.text)[0])
    n = sum(langid.has_letter(r.text) for r in training.collect())
    assert np.allclose(idf, [math.log((n + 1) / (seen[b] + 1)) + 1 for b in range(len(idf))])
    examples = langid.sample(training)
    model, (labels, weights) = langid.fit(examples, idf), plain_fit(examples, idf)
    assert model.labels == labels
    for (b, k), w in weights.items():
        assert model.weights[b, k] == pytest.approx(w, abs=1e-9)
    assert 0 < (model.weights != 0).sum() == sum(w != 0 for w in weights.values()) < len(weights)
    assert len({e[1].tobytes() + e[2].tobytes() for e in examples}) > model.aside > 0 and model.loss < 1.0 and 0 <= model.error < 1


def test_language_of_dirty_labels(spark, docs, odd):
    """Any number of languages: the most frequent ones are learned. Columns that clash in any case are replaced."""
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("lang")).alias("lang"))
    assert len({e[0] for e in langid.sample(rows.filter("lang IS NOT NULL"), languages=3)}) <= 3
    out = langid.identify(odd.withColumn("Lang_Pred", F.lit(1)), docs)
    assert out.columns == [*odd.columns, "lang_pred", "lang_score"] and out.count() == len(ODD)


def test_lm(spark, docs, texts, odd, none):
    got = {r.doc_id: r for r in lm.train_and_score(spark, docs).collect()}
    tokens = {d: [*t.encode().lower().split(), None] for d, t in texts.items()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    one, two = Counter(), Counter()
    for d, t in tokens.items():
        if not out[d]:
            one.update(t), two.update(zip([None, *t[:-1]], t))
    total = sum(one.values())
    kept = {k: n for k, n in two.items() if n >= lm.MIN_BIGRAM}
    mass = Counter()
    for (v, _), n in kept.items():
        mass[v] += (n - lm.DISCOUNT) / one[v]
    q = lambda p: float(lm.dequantise(lm.quantise(np.array([p])))[0])
    for d, t in tokens.items():
        unigram = [(one[w] + 1) / (total + len(one) + 1) for w in t]
        score = 0.0
        for v, w, p in zip([None, *t[:-1]], t, unigram):
            if v in one:
                p = (q((kept[v, w] - lm.DISCOUNT) / one[v]) if (v, w) in kept else 0) + q(max(1 - mass[v], 1e-8)) * p
            score += math.log10(p)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(t), sum(one[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(map(math.log10, unigram))) and r.score == pytest.approx(score)
    assert lm.train_and_score(spark, odd).count() == len(ODD) and lm.train_and_score(spark, none).count() == 0


def test_lm_keeps_pairs_seen_once(spark):
    """A pair seen once in training is no back-off, whether its words are frequent or seen once themselves."""
    training = spark.createDataFrame([(1, "a b a c a d"), (2, "rare odd")], "doc_id long, text string")
    model = lm.train(training, Workspace(spark, "t").at("model"))
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame([(1, "a b"), (2, "rare odd"), (3, "b c")], "doc_id long, text string"), model).collect()}
    one, total = Counter("a b a c a d rare odd".split()), 10  # with two ends
    one[None] = 2
    pairs = Counter([(None, "a"), ("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("a", "d"), ("d", None), (None, "rare"), ("rare", "odd"), ("odd", None)])
    q = lambda p: float(lm.dequantise(lm.quantise(np.array([p])))[0])
    left = lambda v: q(1 - sum((n - lm.DISCOUNT) / one[v] for (x, _), n in pairs.items() if x == v))
    def p(v, w):
        return (q((pairs[v, w] - lm.DISCOUNT) / one[v]) if (v, w) in pairs else 0) + left(v) * (one[w] + 1) / (total + len(one) + 1)
    for d, t in ((1, ["a", "b", None]), (2, ["rare", "odd", None]), (3, ["b", "c", None])):
        assert got[d] == pytest.approx(sum(math.log10(p(v, w)) for v, w in zip([None, *t[:-1]], t)))


@pytest.mark.parametrize("order,split", [(3, False), (4, False), (3, True)])
def test_lm_of_higher_order(spark, docs, texts, odd, none, order, split, monkeypatch):
    """Every n-gram up to the order, discounted and interpolated, against counts in dictionaries; also where the
    successors of frequent words are split over shards."""
    if split:
        monkeypatch.setattr(lm, "HOT_IN_SHARD", 400)
        monkeypatch.setattr(lm, "SPLIT", 400)
        model = lm.train(docs, Workspace(spark, "t").at("m"), order=2)
        assert len(model["split"][0]["contexts"]) > 5 and len(model["bounds"][0]) > 50
    tokens = {d: [*t.encode().lower().split(), None] for d, t in texts.items()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    grams, one = Counter(), Counter()
    for d, t in tokens.items():
        if not out[d]:
            one.update(t)
            s = [None, *t]
            grams.update(tuple(s[i - k + 1 : i + 1]) for i in range(1, len(s)) for k in range(2, order + 1) if i - k + 1 >= 0)
    total, of, mass = sum(one.values()), Counter(), Counter()
    for g, n in grams.items():
        of[g[:-1]] += n
    for g, n in grams.items():
        mass[g[:-1]] += (n - lm.DISCOUNT) / of[g[:-1]]
    q = lambda p: float(lm.dequantise(lm.quantise(np.array([p])))[0])
    some = sorted(tokens)[::4]
    got = {r.doc_id: r.score for r in lm.train_and_score(spark, docs, order).collect()}
    for d in some:
        s, score = [None, *tokens[d]], 0.0
        for i in range(1, len(s)):
            p = (one[s[i]] + 1) / (total + len(one) + 1)
            for k in range(2, min(order, i + 1) + 1):
                g = tuple(s[i - k + 1 : i + 1])
                if of[g[:-1]]:
                    p = (q((grams[g] - lm.DISCOUNT) / of[g[:-1]]) if g in grams else 0) + q(max(1 - mass[g[:-1]], 1e-8)) * p
            score += math.log10(p)
        assert got[d] == pytest.approx(score)
    assert len(got) == len(texts) and lm.train_and_score(spark, odd, order).count() == len(ODD) and lm.train_and_score(spark, none, order).count() == 0


def test_quality_odd(odd, none):
    got = {(r.doc_id, r.n_words): r for r in quality.quality_rules(odd).collect()}
    assert len(got) == len(ODD) - 1 and got[1, 0].kept is False and got[5, len(WS.findall(ODD[4][1]))].kept is True and got[6, 40000].n_repeat_words == 40000
    assert quality.quality_rules(none).count() == 0
    cleaned = quality.clean_documents(odd.sparkSession.createDataFrame([(1, "a fine line of ten words that stays as it is\nAll rights reserved.")], ["doc_id", "text"]))
    assert cleaned.first().text == "a fine line of ten words that stays as it is"


def test_quality_under_a_filter(spark, docs, texts):
    """A filter on the verdict repeats no work: one hash in the plan, and long repeated texts end soon."""
    plan = quality.clean_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1
    line = " ".join(f"x{i}" for i in range(1000))
    rows = [(1, "\n".join([line] * 100)), (2, " ".join(f"y{i}" for i in range(100_000))), (3, "a b c d e f g h i j\n" * 20_000)]
    kept = quality.clean_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [2] and kept[0].text == rows[1][1]
    judged = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert {r.doc_id: r.text for r in quality.clean_documents(docs).collect()} == {d: r.cleaned for d, r in judged.items() if r.kept}


def test_boilerplate_is_most_of_its_line(spark):
    clean = ["The old catalog in the town library lists every book printed before the war.", "They chose a new design upgrade for the bridge after the flood of last spring.",
             "She asked him to sign up for the course that begins in the autumn of this year.", "Die Dialog-In-Kommission tagt in der Nähe von Köln über das neue Gesetz im Land."]
    noise = ["All rights reserved.", "© 2024 All Rights Reserved", "Sign up | Log in", "Subscribe to our newsletter", "CLICK HERE -- read more", "log-in"]
    rows = [(i, x + "\n" + clean[0]) for i, x in enumerate([*clean, *noise])]
    got = {r.doc_id: r.cleaned for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == [t for _, t in rows[:4]] and [got[i] for i in range(4, 10)] == [clean[0]] * 6


def test_quality_clashing_columns(spark):
    text = "a fine line of ten words that stays as it is"
    frame = spark.createDataFrame([(1, text, 7, True, "z")], "doc_id long, text string, n_words long, kept boolean, row string")
    assert quality.clean_documents(frame).collect() == frame.collect()
    assert quality.clean_documents(frame.limit(0)).columns == frame.columns


def test_decontamination_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "same text here"), (2, None), (3, ""), (4, "ONE"), (4, "ONE")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(odd, items).collect())
    assert got == sorted([("1", 0, 0, 0, False), ("2", 0, 0, 0, False), ("3", 0, 0, 0, False), ("4", 1, 1, 1, True), ("5", 11, 3, 1, True), ("5", 11, 3, 1, True), ("6", 40000, 0, 0, False), ("7", 6, 0, 0, False), ("None", 12, 0, 0, False)])
    left = decontam.remove_contaminated(odd, items, Workspace(spark, "t"))
    assert left.columns == odd.columns and left.count() == 6
    assert decontam.contamination(none, items).count() == 0 and decontam.contamination(odd, items.limit(0)).count() == len(ODD)


def brute_contamination(texts, items, window=13):
    """(words, hit words, items) of each text."""
    grams = {}
    for item, t in items:
        w = AL.findall(low(t))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for t in texts:
        w = AL.findall(low(t))
        found = [(i, n, grams[tuple(w[i : i + n])]) for n in {len(g) for g in grams} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams]
        out.append((w, {i + j for i, n, _ in found for j in range(n)}, set().union(*(x for _, _, x in found))))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_and_span_removal(spark, broadcast, monkeypatch):
    """Windows of several lengths, overlapping and repeated, on both sides of the set's size limit."""
    if not broadcast:
        monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", 0)
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"W{x}" for x in rng.integers(0, 400, n))
    items = [(i, word(int(rng.integers(1, 60)))) for i in range(12)] + [(98, "W1 w2, W3"), (99, "w2"), (100, None)]
    texts = []
    for i in range(60):
        parts = [word(int(rng.integers(0, 40))) for _ in range(3)]
        if i % 2:
            chosen = items[int(rng.integers(0, 14))][1].split()
            parts.insert(1, " - ".join(chosen[int(rng.integers(0, 3)) :]))
            parts.insert(2, ("; ".join(chosen) + "!\n") * int(rng.integers(1, 3)))
        texts.append("\t(" + "... ".join(parts) + ")")
    texts += [None, "", "W1 W2 W3", "w1 w2 w3"]
    docs = spark.createDataFrame([(i // 2, t, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars int, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(i // 2, len(w), len(hit), len(names), bool(hit) and 20 * len(hit) >= len(w)) for i, (w, hit, names) in enumerate(brute_contamination(texts, items))]
    got = decontam.contamination(docs, bench).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == sorted(want)
    for r in got:
        ends = [(s.start, s.start + s.length) for s in r.spans]
        assert sum(e - s for s, e in ends) == r.n_hit and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    work = Workspace(spark, "t")
    kept = decontam.remove_contaminated(docs, bench, work)
    assert kept.columns == docs.columns and Counter(r.text for r in kept.collect()) == Counter(t for t, w in zip(texts, want) if not w[4])
    cut = decontam.remove_spans(docs, bench, work)
    assert cut.columns == docs.columns and cut.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    left = Counter()
    for t, w, (words, hit, _) in zip(texts, want, brute_contamination(texts, items)):
        left[t if not w[4] and t != "" else tuple(x for i, x in enumerate(words) if i not in hit)] += 1
    found, changed = Counter(), {t for t, w in zip(texts, want) if w[4]}
    for r in cut.collect():
        found[r.text if r.text != "" and r.text in texts and r.text not in changed else tuple(AL.findall(low(r.text)))] += 1
        assert r.n_chars == len(r.text or "")
    assert found == left


def test_decontamination_of_a_long_text(spark):
    """A text of 200,000 words, all of them hit, is judged in seconds."""
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)) + " x " + " ".join(f"w{i % 40}" for i in range(200_000)))], "doc_id long, text string")
    (r,) = decontam.contamination(docs, items).collect()
    assert (r.n_words, r.n_hit, len(r.spans)) == (200_041, 200_040, 2)


def test_arc_and_warc(spark):
    record = warc.ArcRecord({"URL": "http://a/b c", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "Content-type": "text/html"}, b"x\n\ny")
    for version in (1, 2):
        (back,) = warc.parse_arc(warc.write_arc([record], version))
        assert back.payload == record.payload and back.fields["IP-address"] == "1.2.3.4"
        ((head, block),) = warc.parse_warc(warc.warc_bytes(back))
        assert block == record.payload and head["WARC-Date"] == "2001-02-03T04:05:06Z" and head["WARC-Type"] == "response"
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.write_arc([record], 1)[:-3]))
    pages = [(3, "u", "same"), (1, None, "same"), (2, "v", None), (4, "w", ""), (None, "x", "same"), (5, "y", "ü"), (5, "y", "ü")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(frame, Workspace(spark, "t")), 2).collect())
    assert got == sorted([("3", 4, "revisit", 1), ("1", 4, "response", None), ("2", 0, "response", None), ("4", 0, "revisit", 2), ("None", 4, "revisit", 1), ("5", 2, "response", None), ("5", 2, "revisit", 5)], key=lambda r: (r[0], r[1], r[2]))
    assert warc.read_archives(warc.write_archives(frame.limit(0), Workspace(spark, "t")), 2).count() == 0


def test_warc_records_of_pages(spark):
    """Ids are distinct, revisits name their response's record, URLs come back with their blanks, long pages whole."""
    import pyarrow.fs

    pages = [(1, "http://a/b c", "x" * 3_000_000), (2, None, "x" * 3_000_000), (2, None, "x" * 3_000_000), (3, "http://q/\t\n", "HTTP/1.1 no head"), (3, "http://q/\t\n", "HTTP/1.1 no head"), (4, "u", "\r\n\r\n")]
    manifest = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), Workspace(spark, "t"))
    heads = []
    for row in manifest.collect():
        fs, path = pyarrow.fs.FileSystem.from_uri(row.file)
        with fs.open_input_stream(path, compression=None) as f:
            heads += [h for h, _ in warc.parse_warc(f)]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(heads) == len(pages)
    for h in heads:
        if h["WARC-Type"] == "revisit":
            first = ids[h["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and first["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"]
    got = sorted((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(manifest, 2).collect() if r.page_id != 2)
    assert got == [(1, "http://a/b c", 3_000_000, "response", None), (3, "http://q/%09%0A", 16, "response", None), (3, "http://q/%09%0A", 16, "revisit", 3), (4, "u", 4, "response", None)]
    assert [(r.url, r.record_type, r.refers_to) for r in warc.read_archives(manifest, 2).filter("page_id = 2").collect()] == [(None, "revisit", 1)] * 2


def test_arc_files_of_other_makers(spark):
    """A version-2 Location is where a response redirects to: the record keeps its payload."""
    import gzip

    fields = {"URL": "http://a/", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "Content-type": "text/html"}
    redirect = warc.ArcRecord(fields | {"Result-code": "302", "Location": "http://b/", "Filename": "x.arc"}, b"moved")
    (back,) = warc.parse_arc(warc.write_arc([redirect], 2))
    ((head, block),) = warc.parse_warc(warc.warc_bytes(back))
    assert block == b"moved" and head["WARC-Type"] == "response" and "X-Refers-To" not in head and head["X-ARC-Location"] == "http://b/"
    one, two = (warc.write_arc([redirect, warc.ArcRecord(fields, b"a\n\nb")], v) for v in (1, 2))
    files = [("one", one), ("two", two), ("members", gzip.compress(two[:80]) + gzip.compress(two[80:])), ("empty", b""), ("null", None)]
    frame = spark.createDataFrame(files, "path string, content binary")
    manifest = warc.convert_archives(frame, Workspace(spark, "t"))
    assert [r.records for r in manifest.collect()] == [2, 2, 2]
    got = Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest, 2).collect())
    assert got == Counter({(None, "http://a/", len(p), warc.digest(p), "response", None): 3 for p in (b"moved", b"a\n\nb")})
    with pytest.raises(Exception, match="bad: ARC record"):
        warc.convert_archives(spark.createDataFrame([("bad", one[:-3])], frame.schema), Workspace(spark, "t"))


def test_compaction_meets_another_writer(spark, odd, tmp_path):
    """Runs and commit are of one manifest: with a commit in between compaction fails and loses or doubles nothing."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20, base_bytes=1 << 10)
    for _ in range(6):
        store.append(odd)
    write = store._write

    def interrupted(df, rows_per_shard=0):
        store._write = write
        sharding.ShardStore(spark, store.path, target_bytes=1 << 20, base_bytes=1 << 10).compact()
        return write(df, rows_per_shard)

    store._write = interrupted
    with pytest.raises(RuntimeError, match="another writer"):
        store.compact()
    assert store.read().count() == 6 * len(ODD)


def test_sharding(spark, docs, odd, none, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20, base_bytes=1 << 10)
    store.append(odd.limit(3)), store.append(odd.limit(3))
    for _ in range(6):
        store.append(odd, rows_per_shard=2)
    before = len(store.manifest()["shards"])
    store.compact()
    assert len(store.manifest()["shards"]) < before and store.read().count() == 6 + 6 * len(ODD) and store.read(1).count() == 3
    store.vacuum()
    assert store.read().count() == 6 + 6 * len(ODD)
    old = store.manifest()
    store.append(odd)
    with pytest.raises(RuntimeError):
        store._commit(old, old["schema"], old["shards"])
    assert sharding.shard_documents(none).count() == 0 and sharding.shard_documents(docs).exceptAll(docs).count() == 0


def test_pipeline(spark, docs, texts):
    """Every stage's decision against brute force on what it was given."""
    import corpus_pipeline as pipeline

    stages = {name: f for name, f in pipeline.STAGES}
    work = Workspace(spark, "t")
    kept = {(r.doc_id): r for r in quality.quality_rules(docs).collect() if r.kept}
    frame = work.save(stages["quality rules"](spark, docs, SF), "a")
    assert {r.doc_id for r in frame.collect()} == set(kept) and frame.columns == docs.columns
    told = work.save(stages["language ID"](spark, frame, SF), "b")
    assert told.count() >= 0.98 * frame.count()
    rows = [(r.doc_id, r.text) for r in told.collect()]
    one = work.save(stages["n-gram Jaccard join"](spark, told, SF), "c")
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in brute_components(rows, 5, 80)})
    clean = work.save(stages["benchmark decontamination"](spark, one, SF), "d")
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = AL.findall(low(r.text))
        grams |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    bad = set()
    for r in one.collect():
        w = AL.findall(low(r.text))
        hit = {i + j for g in {len(g) for g in grams} for i in range(len(w) - g + 1) if tuple(w[i : i + g]) in grams for j in range(g)}
        if hit and 20 * len(hit) >= len(w):
            bad.add(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - bad
    packed = stages["packing"](spark, clean, SF).collect()
    e = WordEncoder.of(default_tokenizer())
    assert sum(p.length for p in packed) == sum(len(b) // 4 for b in e.encode([r.text for r in clean.collect()]))


def test_pipeline_stages_on_odd_and_empty_tables(spark, docs, tmp_path):
    """Nulls in any column, repeated rows, long texts, ties, clashing extra columns; and nothing at all."""
    import corpus_pipeline as pipeline

    words = lambda n, k: " ".join(f"word{(7 * i + k) % 999_983}" for i in range(n))
    texts = [(None, words(40, 1)), (1, None), (2, ""), (3, words(40, 2)), (3, words(40, 2)), (4, words(40, 2)), (5, words(30_000, 3)), (6, words(40, 4)), (6, words(40, 5))]
    odd = spark.createDataFrame([(i, t, "en", None, None, "x", 1.5, True) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, n_words string, bad_id double, kept boolean")
    first = pipeline.STAGES[0][1](spark, odd, SF)
    assert first.columns == odd.columns and Counter(r.doc_id for r in first.collect()) == Counter([None, 3, 3, 4, 5, 6, 6])
    third = pipeline.STAGES[2][1](spark, first, SF)
    assert third.columns == odd.columns and Counter(r.doc_id for r in third.collect()) == Counter([None, 3, 5, 6, 6])
    fourth = pipeline.STAGES[3][1](spark, third, SF)
    assert fourth.columns == odd.columns and fourth.count() == 5
    packed = pipeline.STAGES[4][1](spark, fourth, SF)
    assert Counter(r.doc_id for r in packed.filter("start = 0").collect()) == Counter([None, 3, 5, 6, 6])
    told = pipeline.STAGES[1][1](spark, first, SF)
    assert told.columns == odd.columns and {r.lang for r in told.collect()} <= {"en"}
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (out.columns == docs.columns or stage is pipeline.STAGES[-1][1])
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").count() == 0
