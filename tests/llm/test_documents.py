"""Operators over documents against brute force, on a table with every odd row."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from logsift.llm import license_rules, license_scan, pieces, quality
from logsift.llm.decontamination import contaminated, question_and_answer
from logsift.llm.near_duplicates import near_duplicates
from logsift.llm.substring_dedup import substring_dedup
from logsift.llm.suffix_dedup import suffix_dedup
from logsift.llm.suffix_groups import suffix_order

SCHEMA = "doc_id long, text string, n_words long, score double, ids string"


def _documents() -> list[tuple]:
    draw = np.random.default_rng(3)
    vocabulary = ["".join(draw.choice(list("abcdefgh"), 5)) for _ in range(400)]
    prose = lambda n: " ".join(draw.choice(vocabulary, n))
    base, passage = prose(160), prose(90)
    rows = [(1, base), (2, base), (3, base.replace(" ", "\n")), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one two"),
            (9, "one two"), (10, "ONE two"), (11, passage + " " + prose(40)), (12, prose(30) + " " + passage),
            (13, "ab" * 900), (14, "ab" * 700), (15, "é\u2581 \U0001F600 x\x00y " * 60), (16, prose(4000) + base), (None, base)]
    for k in range(20, 32):  # near copies at several distances
        word = base.split()
        for place in draw.choice(len(word), (k - 18) // 2, replace=False):
            word[place] = f"changed{k}"
        rows.append((k, " ".join(word)))
    rows += [(40, "All rights reserved. Licensed under CC BY-NC 4.0; gnu General Public-License, version 3"),
             (41, "SPDX-License-Identifier: Apache-2.0 cc by cc by"), (7, "one")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 0.5, "x") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _unique(rows):
    return sorted({i: (t or "") for i, t in rows if i is not None}.items())


def test_near_duplicates(docs, rows, empty):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for i, t in _unique(rows)}
    sets = {i: ({tuple(w[k : k + 4]) for k in range(len(w) - 3)} or {tuple(w)}) if w else set() for i, w in words.items()}
    component = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    component[i] = min(component[i], component[j])
    found = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert len(found) == len(sets)
    for i, own in sets.items():
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(own), component[i], component[i] == i)
    assert component[3] == 1 and component[10] == 8 and component[5] == 5
    assert near_duplicates(empty).collect() == []


def test_substring_dedup(docs, rows, empty):
    seen: dict = {}
    expected = {}
    for i, t in _unique(rows):
        word = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        mark = [False] * len(word)
        for k in range(len(word) - 12):
            if seen.setdefault(tuple(word[k : k + 13]), i) < i:
                mark[k : k + 13] = [True] * 13
        kept = b" ".join(w for w, m in zip(word, mark) if not m)
        expected[i] = (len(word), sum(mark), hashlib.sha256(kept).hexdigest(), kept.decode())
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup(docs, with_text=True).collect()}
    assert found == expected
    assert substring_dedup(docs).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert substring_dedup(empty).collect() == []


def test_suffix_dedup(docs, rows, empty):
    raw = {i: t.encode() for i, t in _unique(rows)}
    times = Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    found = {r.doc_id: r for r in suffix_dedup(docs).collect()}
    assert found.keys() == raw.keys()
    for i, b in raw.items():
        mark = bytearray(len(b))
        for k in range(len(b) - 399):
            if times[b[k : k + 400]] > 1:
                mark[k : k + 400] = b"\1" * 400
        kept = bytes(c for c, m in zip(b, mark) if not m)
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == (
            len(b), sum(mark), len(re.findall(b"\1+", mark)), hashlib.sha256(kept).hexdigest())
    assert found[13].n_removed == 1800  # a string that repeats inside its own text
    assert suffix_dedup(empty).collect() == []


def test_suffix_order():
    draw = np.random.default_rng(5)
    for _ in range(400):
        text = draw.integers(0, draw.integers(1, 5), draw.integers(0, 40))
        assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_license_scan(docs, rows, empty):
    assert len(license_rules.rules()) > 300
    found = sorted(license_scan.license_scan(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, t in rows:
        word = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in license_rules.BASE for k in range(len(word)) if word[k : k + len(phrase.split())] == phrase.split()]
        r = by_id[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(word), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None),
            ",".join(sorted({label for _, label in places})))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert by_id[40].labels == "cc-by,cc-by-nc,gpl,gpl-3.0,reserved"
    # the name alone lies inside the stronger grant and is suppressed
    assert by_id[40].spans.count("cc-by-nc") == 1
    assert by_id[41].labels == "apache-2.0,cc-by" and by_id[41].n_base == 2 and by_id[41].score > 0.99
    assert by_id[4].labels == "" and by_id[4].score == 0
    assert license_scan.license_scan(empty).collect() == []


def _written(pattern) -> list[str]:
    """Texts of each alternative of a pattern; signs by class as one of their kind."""
    out = [""]
    for kind, value in pattern:
        kind = str(kind)
        if kind == "LITERAL":
            some = [chr(value)]
        elif kind == "IN":
            some = [{"LITERAL": lambda v: chr(v), "CATEGORY": lambda v: "1"}[str(k)](v) for k, v in value]
        elif kind == "BRANCH":
            some = [t for branch in value[1] for t in _written(branch)]
        elif kind == "SUBPATTERN":
            some = _written(value[3])
        else:
            assert kind == "MAX_REPEAT", kind
            some = [""] * (value[0] == 0) + _written(value[2])
        out = [a + b for a in out for b in some]
    return out


def test_license_scan_runs_every_rule_that_matches(spark):
    names = [n for *_, n in license_rules.FAMILIES] + [n for *_, n in license_rules.NOTICES]
    texts = sorted({t for n in names for t in _written(re._parser.parse(n))})
    texts = [form.format(t) for form in ("{}", "licensed under {}", "SPDX-License-Identifier: {}", "the {} license") for t in texts]
    texts += ["licensed under GPL v2", "licensed under the LGPL v2.1", "licensed under MPL v2", "licensed under AGPL-v3.0"]
    compiled = license_scan._compiled()[0]
    found = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = " ".join(re.findall("[a-z0-9]+", t.lower()))
        base, kept = license_scan.detections(words, list(range(len(compiled))))
        place = lambda c: words[:c].count(" ")
        assert found[i].spans == ";".join(f"{d[2]}:{place(d[0])}-{place(d[1])}" for d in sorted(base + kept)), t
    for t, label in (("licensed under GPL2", "gpl-2.0"), ("the GPL3 license", "gpl-3.0"), ("licensed under the LGPL3", "lgpl-3.0"),
                     ("under license LGPL2.1", "lgpl-2.1"), ("licensed under AGPL3", "agpl-3.0"), ("released under the FreeBSD license", "bsd-2"),
                     ("MPL2 license", "mpl-2.0"), ("licensed under GPL v2", "gpl-2.0"), ("licensed under LGPL v2.1", "lgpl-2.1"),
                     ("licensed under MPL v2", "mpl-2.0"), ("without warranty of any kind", "no-warranty")):
        row = license_scan.license_scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
        assert row.labels == label and row.score > 0, t


def test_quality(spark, docs, empty):
    draw = np.random.default_rng(1)
    good = [(1000 + k, " ".join(draw.choice(["the", "of", "house", "river", "walk", "green"], 60))) for k in range(150)]
    bad = [(2000 + k, " ".join(draw.choice(["house%%%", "river&&&", "the***", "walk###"], 60))) for k in range(150)]
    corpus = spark.createDataFrame(good + bad + [(3000, None), (3001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, _ in good + bad] + [(3000, None), (None, 1)], "doc_id long, quality int")
    scored = quality.score_quality(corpus, labels).withColumn("learn", quality.may_learn(quality.F.col("doc_id"))).collect()
    assert len(scored) == 302 and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if not r.learn and r.doc_id < 3000]
    assert held and all((r.score >= 0.5) == (r.doc_id < 2000) for r in held)
    scores = {r.doc_id: r.score for r in scored}
    assert scores[3000] == scores[3001]
    none = quality.score_quality(docs, labels.where("quality > 1")).collect()
    assert {r.score for r in none} == {0.5} and len(none) == docs.count()
    assert quality.score_quality(empty, labels).collect() == []


def test_decontamination(spark, docs, rows, empty):
    base, other = rows[0][1], "completely different words that stand nowhere else. Not here either at all."
    items = [(1, " ".join(base.split()[20:60])), (1, " ".join(base.split()[20:60])), (2, other), (3, None), (4, ""), (5, "..."), (None, base)]
    table = spark.createDataFrame(items, "item_id long, text string")
    long_text = spark.createDataFrame([(99, "filler " * 5000 + other.upper().replace(" ", ", ") + " filler" * 300)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in contaminated(docs.select("doc_id", "text").unionByName(long_text), table).collect()}
    assert {(1, 1), (2, 1), (3, 1), (16, 1), (99, 2)} <= set(found)
    assert not {i for i, _ in found} & {4, 5, 6, 7, 11, 12, 13, 40}
    assert found[1, 1].score == pytest.approx(1) and found[99, 2].answer_overlap == 1
    assert contaminated(docs, table.where("item_id > 2")).collect() == []
    assert contaminated(empty, table).collect() == []
    assert question_and_answer("What is it? A thing.") == ("What is it?", "A thing.")


def test_wand_finds_all_above(spark):
    from logsift.llm.decontamination import Index
    draw = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(draw.choice(words, draw.integers(3, 20))) for _ in range(50)]
    from logsift.llm.decontamination import _found
    df = Counter(h for t in texts for h in set(_found([t]).hash.view(np.int64).tolist()))
    index = Index(list(range(50)), texts, df, 50, np.mean([len(t.split()) for t in texts]))
    terms = [np.unique(draw.integers(0, len(index.terms), 25)) for _ in range(30)]
    passage = np.repeat(np.arange(30), [len(t) for t in terms])
    p, i, s = index.above(passage, np.concatenate(terms), 0.45)
    full = np.zeros((len(index.terms), 50))
    start = np.append(index.entry_start, len(index.item))
    for t in range(len(index.terms)):
        entries = range(index.term_start[t], index.term_start[t] + index.term_size[t])
        for e in entries:
            full[t, index.item[start[e] : start[e + 1]]] = index.impact[start[e] : start[e + 1]]
    expected = {(k, j): full[t, j].sum() for k, t in enumerate(terms) for j in range(50) if full[t, j].sum() >= 0.45}
    assert expected and set(zip(p.tolist(), i.tolist())) == set(expected)
    assert all(abs(expected[a, b] - c) < 1e-9 for a, b, c in zip(p.tolist(), i.tolist(), s.tolist()))


def test_pieces(docs, rows, empty):
    found = pieces.decode(pieces.encode(docs)).collect()
    assert len(found) == len(rows)
    assert all(r.decoded == r.text for r in found)
    assert {len(r.ids) if r.ids is not None else None for r in found if not r.text} == {None, 0}
    model = pieces.Pieces(open(pieces.MODEL, "rb").read())
    scores = dict(zip(model.text.values(), model.score[[_node(model, p) for p in model.text.values()]].tolist()))
    for unit in (" hello", " thinking", "abcé", "aaaaaa", " 日本語", "\U0001F600a"):
        sign = unit.replace(" ", pieces.SPACE)
        best = [0.0] + [-1e18] * len(sign)
        for end in range(1, len(sign) + 1):
            best[end] = max([best[end - 1] + model.fallback, *(best[a] + scores[sign[a:end]] for a in range(end) if sign[a:end] in scores)])
        ids = np.frombuffer(model.segment([sign])[0], np.int32).tolist()
        spelled = sum(i not in model.text for i in ids)
        own = sum(scores[model.text[i]] for i in ids if i in model.text)
        covered = sum(len(model.text[i]) for i in ids if i in model.text)
        assert own + model.fallback * (len(sign) - covered) == pytest.approx(best[-1]) and (spelled > 0) == (covered < len(sign))
    assert pieces.decode(pieces.encode(empty)).collect() == []


def _node(model, text):
    node = 0
    for sign in map(ord, text):
        node = int(model.targets[np.searchsorted(model.keys, node << 21 | sign)])
    return node


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    draw = np.random.default_rng(9)
    x, y, z = (" ".join(draw.choice([f"w{k}" for k in range(3000)], 150)) for _ in range(3))
    rows = [(1, x), (1, y), (1, x), (2, y), (3, z + " " + x), (None, z)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(table).collect())
    assert near == [(1, 147, 1, True), (1, 147, 1, True), (2, 147, 1, False), (3, 297, 3, True)]
    kept = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(table, with_text=True).collect())
    assert kept == sorted([(1, 150, 0, x), (1, 150, 0, y), (2, 150, 150, ""), (3, 300, 150, z)])
    found = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup(table).collect())
    assert found == sorted([(1, len(x), len(x)), (1, len(y), len(y)), (2, len(y), len(y)), (3, len(z + " " + x), len(x))])


@pytest.mark.parametrize("common, held", [(1 << 17, 1 << 17), (5, 40)])
def test_every_token_has_a_vector_of_its_own(spark, monkeypatch, common, held):
    monkeypatch.setattr("logsift.llm.quality.COMMON", common)
    monkeypatch.setattr("logsift.llm.quality.MOST_HELD", held)
    draw = np.random.default_rng(6)
    texts = [" ".join(draw.choice([f"t{k}" for k in range(300)], 1 + k)) + "!? x" for k in range(60)] + ["", None, "lone"]
    texts += texts[:3]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    tokens = {t: re.findall("[a-z0-9]+|[!?]+", t or "") for t in texts}
    names = sorted({w for own in tokens.values() for w in own})
    raw = "".join(names).encode()
    stop = np.cumsum([len(w) for w in names])
    hashes = quality.T.hash_spans(np.frombuffer(raw, np.uint8), np.concatenate([[0], stop[:-1]]), stop)
    index = dict(zip(names, quality.index_vectors(hashes).astype(float)))
    assert all((np.abs(v) == 1).sum() == quality.NONZERO and (v == 0).sum() == quality.DIMENSIONS - quality.NONZERO for v in index.values())
    total, times = {w: np.zeros(quality.DIMENSIONS) for w in names}, Counter()
    for t in texts:
        own = tokens[t]
        for k, w in enumerate(own):
            times[w] += 1
            total[w] = total[w] + sum([index[own[j]] for j in range(max(0, k - 2), min(len(own), k + 3)) if j != k], np.zeros(quality.DIMENSIONS))
    mean = sum(total.values()) / sum(times.values())
    vector = {w: (v := total[w] / times[w] - mean) / (np.linalg.norm(v) or 1) for w in names}
    found = {bytes(r.text_key): np.frombuffer(r.pooled) for r in quality.pooled_texts(table).collect()}
    assert len(found) == len({t or "" for t in texts})
    for t in texts:
        own = found[hashlib.sha256((t or "").encode()).digest()[:16]]
        assert own == pytest.approx(np.mean([vector[w] for w in tokens[t]], axis=0) if tokens[t] else np.zeros(quality.DIMENSIONS), abs=1e-5)


def test_passages_at_the_edge_of_a_window(spark):
    """Strings of 399, 400 and 401 bytes that two documents share."""
    draw = np.random.default_rng(21)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    some = lambda n: "".join(draw.choice(letters, n))
    rows, expected = [], {}
    for k, n in enumerate((399, 400, 401)):
        shared = some(n)
        for j in range(2):
            # other signs on both sides, so that nothing longer is shared
            rows.append((2 * k + j, some(700) + "XY"[j] + shared + "PQ"[j] + some(300)))
            expected[2 * k + j] = n if n >= 400 else 0
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: (n, int(n > 0)) for i, n in expected.items()}


def test_contained_detections_are_dropped():
    from logsift.llm import license_scan

    draw = np.random.default_rng(4)
    grants = ["licensed under the mit license", "under the terms of the gnu general public license version 2", "gpl 2", "apache license version 2 0", "the bsd license", "word"]
    for n in (3, 40):
        text = " ".join(draw.choice(grants, n))
        compiled, _, by_keyword = license_scan._compiled()
        tried = sorted(set().union(*map(set, by_keyword)))
        found = sorted((p, m.start() - m.end(), m.start(), m.end(), label, c) for label, p, c, pattern in (compiled[k] for k in tried) if p
                       for m in pattern.finditer(text) if m.end() > m.start())
        taken = []
        for _, _, a, b, label, c in found:  # by comparing with all that were taken
            if not any(x <= a and b <= y for x, y, *_ in taken):
                taken.append((a, b, label, c))
        assert license_scan.detections(text, tried)[1] == sorted(taken)


@pytest.mark.parametrize("most", [0, 1, 100])
def test_only_copied_texts_meet(spark, monkeypatch, most):
    """Rows of a text without a copy are not shuffled to be one; copies are pooled once however they are found (op4)."""
    plans, cut = [], quality.cut

    def spy(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df)
    monkeypatch.setattr("logsift.llm.quality.cut", spy)
    monkeypatch.setattr("logsift.llm.quality.MOST_COPIED", most)
    known = lambda: next(plan for columns, plan in reversed(plans) if "rare" in columns)
    texts = ["one two three", "two three four five", "six", None]
    single = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once = {bytes(r.text_key): r.pooled for r in quality.pooled_texts(single).collect()}
    assert len(once) == 4 and "Exchange" not in known()
    twice = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "six", None, "", "six"])], "doc_id long, text string")
    found = quality.pooled_texts(twice).collect()
    assert len(found) == 4 and {bytes(r.text_key) for r in found} == set(once)
    assert known().count("MapInArrow") == (1 if most < 2 else 2)


def test_sums_travel_in_the_fewest_bytes():
    """Sums of rare tokens take half a byte each and come back as they were, as larger ones do (op4)."""
    draw = np.random.default_rng(8)
    sums = np.vstack([draw.integers(-most, most + 1, (50, quality.DIMENSIONS)) for most in (1, 7, 8, 127, 128, 40_000, 1 << 40)] + [
        np.full((1, quality.DIMENSIONS), v) for v in (-7, 7, -8, 8, 0, -128, 127)])
    packed = quality._rows(np.arange(len(sums)), np.ones(len(sums), np.int64), sums).column("vector").to_pylist()
    assert (quality._wide(packed) == sums).all()
    assert {len(p) for p, own in zip(packed, sums) if np.abs(own).max() <= 7} == {quality.DIMENSIONS // 2}
    assert quality._wide([]).shape == (0, quality.DIMENSIONS)
