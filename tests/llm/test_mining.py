"""Hard negatives, collocations and language identification against plain versions."""

import math
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsift.llm import collocations as C, hard_negatives as H, language_id as L


# ---- hard negatives ------------------------------------------------------------------------
def _expected_negatives(rows, anchors):
    """rows: id -> (label, whole numbers)."""
    out = set()
    for a in anchors:
        label, x = rows[a]
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, own) for i, (own, y) in rows.items() if i != a and len(y) == len(x))
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            inside = [(n, -t) for t, n, own in scored if own != label and -30 * s <= -100 * t <= -90 * s]
            out |= {(a, p, rank + 1, n, -s, t) for rank, (n, t) in enumerate(inside[:10])}
    return out


@pytest.mark.parametrize("block", [1 << 19, 400])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(H, "ROW_BLOCK", block)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", max(8, block // 20))
    draw = np.random.default_rng(3)
    # few distinct values: many ties, scores of zero and below
    vectors = {i: (i % 3, (draw.integers(-2, 4, 4) / 256).tolist()) for i in range(-40, 400)}
    vectors |= {i: (1, vectors[4][1]) for i in range(500, 560)}  # copies
    vectors |= {i: (i % 2, [0.3, float(i % 7)]) for i in range(600, 620)}  # another length
    odd = [(700, None, [1.0] * 4), (701, 1, None), (702, 1, [1.0, None, 1.0, 1.0]), (703, 1, [math.nan] * 4), (704, 1, [math.inf] * 4),
           (720, 1, []), (None, 1, [1.0] * 4)]
    table = [(i, own, x, "a", 1) for i, (own, x) in vectors.items()] + [(*o, "b", 2) for o in odd]
    table += [(0, *vectors[0], "c", 3)] * 2  # a repeated row
    frame = spark.createDataFrame(table, "vec_id long, label int, embedding array<double>, row_id string, windows int").repartition(3)
    found = [tuple(r) for r in H.hard_negatives(frame, lambda i: i % 20 == 0).collect()]
    rows = {i: (own, [math.floor(256 * v) for v in x]) for i, (own, x) in vectors.items()}
    assert len(found) == len(set(found))
    assert set(found) == _expected_negatives(rows, [i for i in rows if i % 20 == 0])
    assert H.hard_negatives(frame.where("vec_id < -100"), lambda i: i % 20 == 0).collect() == []
    assert H.hard_negatives(frame, lambda i: i == 12345).collect() == []


def test_hard_negatives_of_large_numbers(spark):
    draw = np.random.default_rng(5)
    vectors = {i: (i % 2, (draw.random(3) * 10.0 ** draw.integers(0, 6)).tolist()) for i in range(60)}
    vectors |= {60: (0, [2.0**26, 1.0, 2.0**26]), 61: (1, [2.0**26 + 1, 3.0, 2.0**25])}  # products beyond 2^53
    frame = spark.createDataFrame([(i, own, x) for i, (own, x) in vectors.items()], "vec_id long, label int, embedding array<double>")
    rows = {i: (own, [math.floor(256 * v) for v in x]) for i, (own, x) in vectors.items()}
    found = {tuple(r) for r in H.hard_negatives(frame, lambda i: i % 20 == 0).collect()}
    assert found == _expected_negatives(rows, [0, 20, 40, 60])
    huge = spark.createDataFrame([(0, 0, [1e200]), (1, 0, [1e200]), (2, 1, [1e199]), (3, 1, [1e-200])], "vec_id long, label int, embedding array<double>")
    assert {tuple(r) for r in H.hard_negatives(huge, lambda i: i == 0).collect()} == set()  # 2^63 - 1 is not below itself


def test_packed_keys_sort():
    draw = np.random.default_rng(2)
    rows = [(int(a), int(s), int(k), int(i)) for a, s, k, i in zip(
        draw.integers(-3, 3, 300), draw.integers(-5, 5, 300), draw.integers(0, 2, 300), draw.integers(-(2**63), 2**63 - 1, 300))]
    keys = [H.packed_keys(np.array([a]), np.array([s]), k, np.array([i]))[0].as_py() for a, s, k, i in rows]
    assert [r for _, r in sorted(zip(keys, rows))] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
    assert list(zip(*H.unpacked_keys(pa.array(keys, pa.binary())))) == rows


# ---- collocations ----------------------------------------------------------------------------
def _pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def _phrase_counts(docs, longest):
    counts = Counter()
    for lang, text in docs:
        for words in _pieces(text):
            for i in range(len(words)):
                for m in range(1, longest + 1):
                    if i + m <= len(words):
                        counts["und" if lang is None else lang, tuple(words[i : i + m])] += 1
    return counts


def _expected_collocations(docs, longest, least, top):
    f = _phrase_counts(docs, longest)
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c * (len(p) == 1)
    often = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    by_lang = defaultdict(list)
    for (lang, p), a in often.items():
        if any(o == lang and len(q) > len(p) and 100 * c >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), c in often.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        by_lang[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, rank + 1, p.decode(), -a, left, right, n[lang], -s)
            for lang, rows in by_lang.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


def _sentences(seed, n):
    draw = np.random.default_rng(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", " x", "a\x0bb", "x-y", "ǘ", "zz"]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", " ;", "?!", "\x0c"]
    weights = np.array([20, 5, 5, 1, 1, 1, 1, 1, 1, 1, 1, 1]) / 39
    texts = ["".join(w + g for w, g in zip(draw.choice(words, 80, p=weights), draw.choice(gaps, 80, p=[0.6, *[0.05] * 8]))) for _ in range(n)]
    return texts + ["new york city " * 50, "the of the of " * 300]


@pytest.mark.parametrize("longest, top", [(2, 2000), (3, 2000), (4, 7)])
def test_collocations(spark, longest, top):
    docs = [(["en", "fr", None, ""][k % 4], t) for k, t in enumerate(_sentences(1, 60))] + [("en", None), ("en", ""), (None, "..."), ("xx", "a b")]
    docs += docs[:3]
    frame = spark.createDataFrame([(lang, t, 1, "p") for lang, t in docs], "lang string, text string, a int, phrase string").repartition(5)
    found = [tuple(r) for r in C.collocations(frame, longest, 4, top=top).collect()]
    assert len(found) == len(set(found))
    assert set(found) == _expected_collocations(docs, longest, 4, top)
    assert C.collocations(frame.where("lang = 'none'")).collect() == []


def test_exact_scores(spark):
    # 10^6 a^2 and l r pass 64 bits
    big = 3 * 10**12
    rows = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long")
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    score = f"({whole('a')} * {whole('a')} * cast(1000000 as decimal(7, 0))) div ({whole('l')} * {whole('r')})"
    assert rows.select(F.expr(score)).first()[0] == 10**6 * big * big // ((big + 1) * (big + 2))


def test_multikey_quicksort():
    draw = np.random.default_rng(6)
    for n, words in ((0, 3), (1, 3), (2000, 3), (2000, 40)):
        suffixes = draw.integers(0, words, (n, 3)).astype(np.uint64)
        suffixes[:, 1:] *= np.cumprod(suffixes[:, 1:] > 0, axis=1).astype(np.uint64)
        suffixes[:, 0] += np.uint64(1)
        weight = draw.integers(1, 4, n)
        expected = Counter()
        for row, w in zip(suffixes.tolist(), weight.tolist()):
            for m in range(1, 4):
                if all(row[:m]):
                    expected[tuple(row[:m])] += w
        found = {tuple(suffixes[p, :d].tolist()): w for d, ps, ws in C.multikey_quicksort(suffixes, weight, 5) for p, w in zip(ps.tolist(), ws.tolist())}
        assert found == {k: c for k, c in expected.items() if c >= 5}


@pytest.mark.parametrize("buckets, flush, often", [(1, 1 << 20, 10**9), (3, 50, 2), (5, 700, 1)])
def test_suffixes_split_and_flushed(monkeypatch, buckets, flush, often):
    """The tasks' work in one process: pairs split or not, suffixes sent in one go or in many."""
    monkeypatch.setattr(C, "FLUSH", flush)
    monkeypatch.setattr(C, "OFTEN", often)
    monkeypatch.setattr(C, "MOST_HELD", flush)
    docs = [("en", t) for t in _sentences(4, 30)]
    batches = [pa.RecordBatch.from_pydict({"lang": [x for x, _ in some], "text": [t for _, t in some]}) for some in (docs[:7], docs[7:])]
    counts, split, names = Counter(), set(), {}
    blobs = sorted((b, p) for r in C._counted(iter(batches), buckets) for b, p in zip(r.column("bucket").to_pylist(), r.column("payload").to_pylist()))
    for batch in C._added(pa.RecordBatch.from_pydict({"bucket": [b], "payload": [p]}) for b, p in blobs):
        for key, _, word, c in zip(*[batch.column(n).to_pylist() for n in C._COUNTED]):
            if word is None:
                split.add(np.frombuffer(key, np.uint64)[0])
            else:
                counts[word] += c
                names[key] = word
    expected = _phrase_counts(docs, 3)
    assert counts == {p[0]: c for (_, p), c in expected.items() if len(p) == 1}
    assert (often < 10) == bool(split)
    bitmap = np.zeros(1 << 13, np.uint8)
    for key, word in names.items():
        place = int(np.frombuffer(key, np.uint64)[0]) & 0xFFFF
        bitmap[place >> 3] |= (128 >> (place & 7)) * (counts[word] >= 4)
    # some of the words travel as numbers, the others as hashes
    common = C.CommonWords(np.array([np.frombuffer(k, np.uint64)[0] for k, w in names.items() if counts[w] >= 20], np.uint64))
    names = {common.names(np.frombuffer(k, np.uint64)).tobytes(): w for k, w in names.items()}
    assert {len(k) for k in names} == {8} and min(int(np.frombuffer(k, np.uint64)[0]) for k in names) == 1
    known = SimpleNamespace(value=(bitmap, np.sort(np.array(list(split), np.uint64)), common))
    blobs = sorted((b, p) for r in C._suffixes(iter(batches), 3, buckets, known) for b, p in zip(r.column("bucket").to_pylist(), r.column("payload").to_pylist()))
    sent = [pa.RecordBatch.from_pydict({"bucket": [b], "payload": [p]}) for b, p in blobs]
    found = [(p, c) for r in C._phrases(iter(sent), 3, buckets, 4) for p, c in zip(r.column("phrase").to_pylist(), r.column("c").to_pylist())]
    assert len(found) == len({p for p, _ in found})
    assert {(" ".join(names[p[k : k + 8]] for k in range(0, len(p), 8)), c) for p, c in found} == {
        (" ".join(p), c) for (_, p), c in expected.items() if len(p) > 1 and c >= 4}


# ---- language identification -----------------------------------------------------------------
def _read(text):
    """Words of letters and marks, in lower case."""
    import unicodedata
    kept = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else c if unicodedata.category(c)[0] == "M" else " " for c in text or "")
    return kept.split()


def _grams(text):
    """Each predicted character with up to three before it in its word."""
    return [f" {w} "[max(0, i - 3) : i + 1] for w in _read(text) for i in range(1, len(w) + 2)]


class _Plain:
    """Interpolated Kneser-Ney by its definition."""

    def __init__(self, grams, size):
        self.base = 1 / (size + 1)
        self.c = {4: Counter(g for g in grams if len(g) == 4)}
        for k in (3, 2, 1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
            if k > 1:
                self.c[k].update(g for g in grams if len(g) == k)
        self.d = {}
        for k, c in self.c.items():
            n1, n2 = (sum(v == n for v in c.values()) for n in (1, 2))
            self.d[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))

    def p(self, gram):
        k = len(gram)
        if not k:
            return self.base
        after = {g: n for g, n in self.c[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return self.p(gram[1:])
        total = sum(after.values())
        return max(after.get(gram, 0) - self.d[k], 0) / total + self.d[k] * len(after) / total * self.p(gram[1:])


def _texts(seed, n):
    draw = np.random.default_rng(seed)
    sounds = {"aa": ["ba", "na", "ña", "li"], "bb": ["str", "un", "eß", "li"], "cc": ["да", "не", "ло", "ба"]}
    out = []
    for k in range(n):
        lang = list(sounds)[k % 3]
        out.append((k, " ".join("".join(draw.choice(sounds[lang], draw.integers(1, 4))) for _ in range(draw.integers(3, 30))) + ", 12 Éa!", lang))
    return out


def test_kneser_ney_both_ways(spark, monkeypatch):
    docs = _texts(1, 90)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    model = L.fit_languages(frame)
    assert model.langs == ["aa", "bb", "cc"]
    aside = {r.doc_id for r in frame.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)), F.lit(L.CALIBRATION)) == 0).collect()}
    assert aside
    learnt = {lang: [g for i, t, x in docs if x == lang and i not in aside for g in _grams(t)] for lang in model.langs}
    size = len({g[-1] for grams in learnt.values() for g in grams})
    plain = [_Plain(learnt[lang], size) for lang in model.langs]
    asked = [(1, "banana strunli", None), (2, "Ñ Ça ДА qq", None), (3, None, None), (4, "", None), (5, "12 -- —", None), (6, "́", None),
             (1, "banana strunli", None), (None, "xa" * 3000, None), (8, "a\nb\x00c d́e \U00010400", None)]
    frame = spark.createDataFrame(asked, "doc_id long, text string, costs string")
    expected = sorted((i is None, i or 0, sum(c.isalpha() for c in t or ""), len(_grams(t)), [-sum(math.log(m.p(g)) for g in _grams(t)) for m in plain]) for i, t, _ in asked)
    for cells in (1 << 22, 0):
        monkeypatch.setattr(L, "MODEL_CELLS", cells)
        found = sorted((r.doc_id is None, r.doc_id or 0, r.letters, r.n, list(r.costs)) for r in L.sums(frame, model).collect())
        assert [r[:4] for r in found] == [r[:4] for r in expected]
        assert np.allclose([r[4] for r in found], [r[4] for r in expected], rtol=1e-5)


@pytest.mark.parametrize("cells", [1 << 22, 0])
def test_languages(spark, monkeypatch, cells):
    monkeypatch.setattr(L, "MODEL_CELLS", cells)
    docs = [(i, t, lang, "x", 1) for i, t, lang in _texts(2, 200)]
    odd = [(None, "banana", "aa"), (1000, None, "aa"), (1001, "", "bb"), (1002, "12 34", None), (1003, "данело", None), (1003, "данело", None)]
    frame = spark.createDataFrame([*docs, *[(*o, "y", 2) for o in odd]], "doc_id long, text string, lang string, score string, n int").repartition(3)
    learn = F.col("doc_id") % 4 != 2
    found = L.identify_languages(frame, learn).collect()
    assert len(found) == len(docs) + len(odd)
    truth = {i: lang for i, _, lang, *_ in docs}
    assert all(r.lang_pred == truth[r.doc_id] and not r.rejected for r in found if r.doc_id in truth and r.doc_id % 4 == 2)
    assert all(0 <= r.score <= 1 for r in found)
    other = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in found if r.doc_id not in truth}
    assert [other[i] for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert other[1003][0] == "cc" and other[None][0] == "aa"
    assert L.identify_languages(frame.where("doc_id < 0"), learn).collect() == []
    nothing = L.identify_languages(frame.where("doc_id = 1003"), learn).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)] * 2


def test_calibration():
    entropies = np.array([[1.0, 2.0], [2.0, 1.0], [1.0, 1.5], [1.2, 1.25]])
    truth = np.array([0, 1, 0, 1])
    temperature, threshold = L.calibrated(entropies, truth, 0.0)
    score = 1 / np.exp((entropies.min(1, keepdims=True) - entropies) / temperature).sum(1)
    assert (score[:3] >= threshold).all() and score[3] < threshold
    assert L.calibrated(entropies, truth, 0.25)[1] == pytest.approx(score[3])


def test_calibration_reads_all_documents(spark, monkeypatch):
    """Beyond what the driver gets, sums over all rows give the same temperature and threshold."""
    draw = np.random.default_rng(3)
    docs = [(i, t, lang if draw.random() > 0.15 else "aa") for i, t, lang in _texts(5, 600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    fitted = []
    for most in (20_000, 3):
        monkeypatch.setattr(L, "MOST_CALIBRATED", most)
        model = L.fit_languages(frame, most_wrong=0.1)
        fitted.append((model.temperature, model.threshold))
    assert fitted[0] == pytest.approx(fitted[1], rel=1e-9)
