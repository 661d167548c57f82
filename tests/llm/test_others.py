"""Vectors, urls and conversations, and the corpus pipeline."""

import hashlib
import importlib.util
import sys
from pathlib import Path

import numpy as np
import pytest

from logsift.llm import chat_format, url_rules
from logsift.llm.vantage_search import nearest


def _expected_nearest(vectors, asked, k):
    out = set()
    for q in asked:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], x)), i) for i, x in vectors.items() if i != q)
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shard_rows", [16_384, 300])
def test_nearest(spark, monkeypatch, shard_rows):
    monkeypatch.setattr("logsift.llm.vantage_search.SHARD_ROWS", shard_rows)
    draw = np.random.default_rng(4)
    vectors = {i: (draw.integers(-4, 5, 6) + (draw.integers(0, 5, 6) if i % 2 else 0)).astype(float).tolist() for i in range(900)}
    vectors |= {i: vectors[3] for i in range(1000, 1060)}  # copies: ties go to the smaller id
    vectors = {i: v for i, v in vectors.items() if any(v)}
    odd = [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6),
           (2005, [9.0] * 5), (2006, []), (None, [9.0] * 6), (3, vectors[3])]
    table = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>").repartition(3)
    found = {(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(table, lambda i: i % 20 == 0).collect()}
    assert found == _expected_nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert nearest(table.where("vec_id < 0"), lambda i: i % 20 == 0).collect() == []


def test_nearest_recall_by_factor(spark):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(30, 16))
    vectors = {i: (centres[i % 30] + 0.3 * draw.normal(size=16)).tolist() for i in range(3000)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    expected = _expected_nearest(vectors, range(0, 3000, 100), 20)
    found = {(r.query_id, r.vec_id) for r in nearest(table, lambda i: i % 100 == 0, factor=1.5).collect()}
    assert len({(q, i) for q, _, i, _ in expected} & found) >= 0.9 * len(expected)


def test_urls(spark):
    urls = ["https://A.Example.org/es/x?q#f", "http://example.org/en/12", "http://org/en/", "http://sub.example.org", "x://com/fr/1", "ftp://a.com/de/",
            "http://notcom/fr/", "http://my.example.orgs/es/", None, "", "no-scheme.org/es/", "http://", "http:///es/", "http://example.org?/es/",
            "http://b.org/a://c.com/de/", "http://com/de/\nline", "http://é.com/de/"]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
             ("example.org", "/en/1", "block"), ("example.org", "/en/1", "allow"), ("", "/", "block"), (None, "/", "block")]
    table = [(k, u, "html") for k, u in enumerate(urls * 40)] + [(None, urls[0], "html"), (0, urls[0], "html")]
    pages = spark.createDataFrame(table, "page_id long, url string, host string")

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        head = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:head])
        path = rest[head:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))
    for cores in ("4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", cores)
        found = url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
        assert sorted(map(str, found)) == sorted(str((i, *judged(u))) for i, u, _ in table) or sorted(
            (str(r.page_id), *map(str, r[1:])) for r in found) == sorted((str(i), *map(str, judged(u))) for i, u, _ in table)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert url_rules.judge_urls(pages.where("page_id < 0"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect() == []


def test_chats(spark):
    probe = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<b[c]"), (1, 2, "assistant", None), (1, 3, "assistant", "\\"), (1, 4, "user", probe),
            (2, 1, "user", probe), (2, 1, "assistant", probe), (3, None, None, ""), (3, 2, "assistant", "<\\[\\<<s>"), (None, 1, "assistant", "é\U0001F600"),
            (4, 1, "user", "x"), (4, 1, "user", "x"), (5, 1, "[INST]</s>", "y" * 100_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_chats(table)
    found = {r.conv_id: r for r in chat_format.digests(chat_format.read_back(formatted)).collect()}
    masks = {r.conv_id: (r.formatted, r.loss_runs) for r in formatted.collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(text for _, role, text in own if role == "assistant")
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (
            len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(masks[conv][0]))
        written, runs = masks[conv]
        assert sum(runs) == len(written)
        edges = np.cumsum([0, *runs])
        under = "".join(written[a:b] for a, b in zip(edges[1::2], edges[2::2]))
        for mark, plain in (("[\\", "["), ("<\\", "<"), ("\\\\", "\\")):
            under = under.replace(mark, plain)
        assert under == loss
    assert chat_format.digests(chat_format.read_back(chat_format.format_chats(table.where("conv_id > 9")))).collect() == []


def test_pipeline(spark):
    path = Path(__file__).parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
    pipeline = sys.modules["corpus_pipeline"] = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pipeline)
    sf = "/root/testdata/sf0.001"
    source = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = pipeline.run(spark, sf).collect()
    assert 0 < len(out) < len(source) and len({r.doc_id for r in out}) == len(out)
    assert all(r.restored and r.n_chars == len(r.text) and r.lang == source[r.doc_id].lang for r in out)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(item in r.text for item in items for r in out)
    # what is left of a text is a subsequence of its words
    for r in out:
        words = iter(source[r.doc_id].text.split())
        assert all(w in words for w in r.text.split())
    gone = set(source) - {r.doc_id for r in out}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = [r.text for r in source.values()]
    lone = [i for i in gone if labels.get(i) == 1 and texts.count(source[i].text) == 1 and not any(t in source[i].text for t in items)]
    assert len(lone) < len(source) * 0.1


def _pipeline():
    path = Path(__file__).parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
    pipeline = sys.modules["corpus_pipeline"] = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pipeline)
    return pipeline


def _tables(spark, folder, rows, schema):
    """A folder of tables: the benchmark has two items, all labels are good."""
    items = ["which colour does the lake have on a quiet day? it is green like the old glass of a bottle",
             "who carried those heavy stones up here? nine tired masons from two villages did so in spring"]
    spark.createDataFrame(rows(*items), schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_keeps_rows_with_missing_and_repeated_ids(spark, tmp_path):
    draw = np.random.default_rng(12)
    a, b, c, d, e = (" ".join(draw.choice([f"w{k}" for k in range(3000)], 60)) for _ in range(5))
    shared = " ".join(a.split()[10:30])

    def rows(one, other):
        return [(1, a), (1, b), (1, b), (2, b), (None, c), (None, d), (None, a), (None, e + " " + shared), (None, ""), (3, None),
                (4, one), (4, "short"), (None, f"before {other} after")]
    sf = _tables(spark, tmp_path, rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.text) for r in _pipeline().run(spark, sf).collect()), key=str)
    assert found == sorted([(1, a), (1, b), (None, c), (None, d), (None, e), (None, ""), (3, None), (4, "short")], key=str)


def test_pipeline_keeps_columns_with_clashing_names(spark, tmp_path):
    draw = np.random.default_rng(13)
    a, b, c = (" ".join(draw.choice([f"w{k}" for k in range(3000)], 60)) for _ in range(3))
    repeated = " ".join(a.split()[5:40])

    def rows(one, other):
        return [(1, a, 9.0, [7], "yes", 3, "t1"), (2, b + " " + repeated, 0.1, None, None, None, None), (3, c, -1.0, [], "no", 5, "t3"), (4, one, 1.0, [1], "x", 1, "t4"),
                (5, a, 1.0, [1], "x", 1, "t5")]
    sf = _tables(spark, tmp_path, rows, "doc_id long, text string, score double, ids array<int>, restored string, n_words long, _tag string")
    found = _pipeline().run(spark, sf)
    assert found.columns == ["doc_id", "text", "score", "ids", "restored", "n_words", "_tag", "ids_", "restored_"]
    assert sorted(map(str, found.drop("ids_").collect())) == sorted(map(str, spark.createDataFrame(
        [(1, a, 9.0, [7], "yes", 3, "t1", True), (2, b, 0.1, None, None, None, None, True), (3, c, -1.0, [], "no", 5, "t3", True)], found.drop("ids_").schema).collect()))


def _words(text, lower=False):
    import re
    text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    """Each stage on what the one before really kept: exact rows and texts."""
    from logsift.llm import pieces, quality
    from logsift.llm.decontamination import contaminated

    pipeline, sf = _pipeline(), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(pipeline.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    def after(name, df):
        stages[name](spark, df, sf).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    good = after("quality", docs)
    scores = {r.doc_id: r.score for r in quality.score_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert texts(good) == {i: t for i, t in texts(docs).items() if scores[i] >= 0.5}

    before = texts(good)
    words = {i: _words(t, lower=True) for i, t in before.items()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    group = {i: i for i in before}
    for i in sorted(before):
        for j in sorted(before):
            if i < j and shingles[i] and shingles[j] and 10 * len(shingles[i] & shingles[j]) >= 8 * len(shingles[i] | shingles[j]):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    lone = after("near_duplicates", good)
    assert texts(lone) == {i: t for i, t in before.items() if group[i] == i} and len(set(group.values())) < len(group)

    before = texts(lone)
    words = {i: _words(t) for i, t in before.items()}
    first, expected = {}, {}
    for i in sorted(before):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        if not gone:
            expected[i] = before[i]
        elif len(gone) < len(w):
            expected[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    rest = after("substrings", lone)
    assert texts(rest) == expected and expected != before

    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaks = {r.doc_id for r in contaminated(rest.select("doc_id", "text"), items).collect()}
    whole = {i for i, t in texts(rest).items() if any(r.text in t for r in items.collect())}
    clean = after("benchmark", rest)
    assert whole <= leaks and texts(clean) == {i: t for i, t in texts(rest).items() if i not in leaks}

    last = after("pieces", clean)
    model = pieces.Pieces(open(pieces.MODEL, "rb").read())
    assert texts(last) == texts(clean) and all(r.restored for r in last.collect())
    for r in last.limit(5).collect():  # word by word as the whole text at once
        unit = (" " + r.text[:200]).replace(" ", pieces.SPACE)
        if "\n" not in unit and pieces.SPACE not in r.text:
            at_once = np.frombuffer(model.segment([unit])[0], np.int32).tolist()
            assert at_once[:20] == r.ids[:20]
