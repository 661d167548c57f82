"""Search against brute force, ties, padding, blocks, copies and citations."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logsift import constants as C
from logsift.operators import features as D, matching as M, retrieval as R


def grams(text):
    tokens = [t for t in text.split() if len(t) > 1]
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def brute_vectors(docs, fit, min_df, sublinear):
    df = Counter(t for text in fit for t in set(grams(text)))
    idf = {t: math.log((1 + len(fit)) / (1 + n)) + 1 for t, n in df.items() if n >= min_df}
    out = []
    for text in docs:
        tf = {t: n for t, n in Counter(grams(text)).items() if t in idf}
        w = {t: ((1 + math.log(n)) if sublinear else n) * idf[t] for t, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1
        out.append({t: v / norm for t, v in w.items()})
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [" ".join(rng.choices(words, k=rng.randint(3, 15))) for _ in range(40)]
    docs += [docs[0]] * 20  # a third of the index is one text
    queries = [" ".join(rng.choices(words + ["unseen"], k=8)) for _ in range(15)] + ["zz qq", docs[0]]
    return docs, queries


def expected(docs, queries, k):
    d, q = brute_vectors(docs, docs, 2, True), brute_vectors(queries, docs, 2, True)
    rows = set()
    for i, qv in enumerate(q):
        scores = [(round(sum(w * dv.get(t, 0) for t, w in qv.items()), 9), j) for j, dv in enumerate(d)]
        for rank, (_, j) in enumerate(sorted(scores, reverse=True)[:k], 1):
            rows.add((i, rank, j))
    return rows


@pytest.mark.parametrize("blocks", [1, 5])
def test_search_matches_brute_force(spark, corpus, blocks, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(R, "BLOCK_ROWS", 60 // blocks)
    known = spark.createDataFrame([(i, i, t, i % 2) for i, t in enumerate(docs)], "doc_id long, doc_pos long, text string, label int")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    index = R.build_index(known)
    assert index.blocks == blocks
    found = R.search_batch(asked, index)
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in found.collect()} == expected(docs, queries, 3)


def test_zero_similarity_documents_fill_up(spark):
    known = spark.createDataFrame([(i, i, "aa bb", 0) for i in range(2)] + [(2, 2, "cc dd", 1), (3, 3, "cc dd", 1)],
                                  "doc_id long, doc_pos long, text string, label int")
    asked = spark.createDataFrame([(0, "aa bb")], "query_id long, text string")
    rows = R.search_batch(asked, R.build_index(known)).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [1, 0, 3] and rows[2]["score"] == 0.0


def test_blank_query_raises_and_empty_batch_is_empty(spark):
    known = spark.createDataFrame([(0, 0, "aa bb", 0), (1, 1, "aa bb", 1)], "doc_id long, doc_pos long, text string, label int")
    index = R.build_index(known)
    asked = spark.createDataFrame([(0, "  ")], "query_id long, text string")
    with pytest.raises(Exception, match="cannot be empty"):
        R.search_batch(asked, index).collect()
    assert R.search_batch(asked.limit(0), index).count() == 0


def test_dense_blend_and_weights(spark):
    rng = random.Random(1)
    vec = lambda: [rng.random() for _ in range(4)]
    d, q = [vec() for _ in range(20)], [vec() for _ in range(5)]
    index = D.vector_rows(spark.createDataFrame(
        [(i, i, v) for i, v in enumerate(d)], "doc_id long, doc_pos long, embedding array<double>"), None, ["doc_id"], ["doc_pos", "embedding"])
    queries = D.vector_rows(spark.createDataFrame(
        list(enumerate(q)), "query_id long, embedding array<double>"), None, ["query_id"], ["embedding"])
    found = M.top_matches(queries, index, 4, semantic_weights=(1.0,), index_blocks=3)
    for i, qv in enumerate(q):
        best = sorted(range(20), key=lambda j: -sum(a * b for a, b in zip(qv, d[j])))[:4]
        assert [r["doc_id"] for r in found.filter(F.col("query_id") == i).orderBy("rank").collect()] == best
    with pytest.raises(ValueError):
        M.top_matches(queries, index, 1, semantic_weights=(1.5,))


@pytest.mark.parametrize("sent, hot, rows", [(32 << 20, 0.04, 4000), (0, 0.04, 9), (32 << 20, 2.0, 7), (0, 0.0, 4000)])
def test_blocks_by_broadcast_or_in_pairs(spark, corpus, monkeypatch, sent, hot, rows):
    """Queries sent to all tasks or met in pairs; terms all, some or none in the dense matrix."""
    docs, queries = corpus
    monkeypatch.setattr(M, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(R, "BLOCK_ROWS", rows)
    known = spark.createDataFrame([(o, f"d{i:03}", i, t, i % 2) for o in (None, "a") for i, t in enumerate(docs)],
                                  "organization string, doc_id string, doc_pos long, text string, label int")
    asked = spark.createDataFrame([(o, i, t) for o in (None, "a", "none of it") for i, t in enumerate(queries)], "organization string, query_id long, text string")
    index = R.build_index(known, scope=("organization",))
    assert index.packed.agg(F.sum("rows")).first()[0] < 2 * len(docs)  # copies are cut
    found = R.search_batch(asked, index).collect()
    expected_rows = expected(docs, queries, 3)
    for o in ("", "a"):
        assert {(r.query_id, r["rank"], int(r.doc_id[1:])) for r in found if r.organization == o} == expected_rows
    assert len(found) == 2 * len(expected_rows)


@pytest.mark.parametrize("larger", ["queries", "both"])
def test_larger_sides_are_not_copied(spark, corpus, monkeypatch, larger):
    """A small index goes to the queries; two large sides meet without a shuffle of index blocks for each query block."""
    docs, queries = corpus
    monkeypatch.setattr(R, "BLOCK_ROWS", 9)
    monkeypatch.setattr(M, "HELD_BYTES", 12 << 20)
    monkeypatch.setattr(M, "PASSING_BYTES", 12 << 20)
    sizes = iter([33 << 20, (1 if larger == "queries" else 33) << 20])
    monkeypatch.setattr(M, "_packed_bytes", lambda blocks: next(sizes))
    known = spark.createDataFrame([(i, i, t) for i, t in enumerate(docs)], "doc_id long, doc_pos long, text string")
    asked = spark.createDataFrame([(100 * n + i, t) for n in range(6) for i, t in enumerate(queries)], "query_id long, text string")
    found = R.search_batch(asked, R.build_index(known))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("CartesianProduct" in plan) == (larger == "both") and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    rows = found.collect()
    for n in range(6):
        assert {(r.query_id - 100 * n, r["rank"], r.doc_id) for r in rows if r.query_id // 100 == n} == expected(docs, queries, 3)


def test_blocks_of_a_small_index_are_few(spark):
    """However many partitions hold its rows."""
    known = spark.range(400).repartition(40).selectExpr("id AS doc_id", "id AS doc_pos", "concat('word ', id) AS text")
    assert R.build_index(known).packed.count() == 1


def test_postings_equal_the_plain_product(monkeypatch):
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(7)
    sides = []
    for name, n in (("doc_id", 90), ("query_id", 40)):
        terms = [sorted(draw.choice(60, draw.integers(0, 25), replace=False, p=np.arange(60, 0, -1) / 1830).tolist()) for _ in range(n)]
        table = {name: list(range(n)), "term_ids": [t or None for t in terms], "weights": [draw.random(len(t)).tolist() or None for t in terms]}
        sides.append((terms, table | ({"doc_pos": list(range(n))} if name == "doc_id" else {})))
    kinds = [("term_ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64()))]
    blocks, full = [], []
    for (terms, table), name in zip(sides, ("doc_id", "query_id")):
        arrow = pa.table({c: pa.array(v, dict(kinds).get(c, pa.int64())) for c, v in table.items()})
        blocks.append(M._Block(M._payload(arrow, name)))
        matrix = np.zeros((len(terms), 60))
        for k, t in enumerate(terms):
            matrix[k, t] = table["weights"][k] or 0
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        full.append(matrix[::-1] if name == "doc_id" else matrix)  # later documents first
    block, asked = blocks
    for share, pairs in ((0.0, 10**6), (0.2, 50), (9.0, 7)):
        monkeypatch.setattr(M, "HOT_SHARE", share)
        monkeypatch.setattr(M, "_PAIRS", pairs)
        found = M._Postings(block).scores(asked.row, asked.term, asked.weight, asked.n)
        assert np.allclose(found, full[1] @ full[0].T, atol=1e-12)


def test_stored_index_is_read_where_it_lies(spark, corpus, tmp_path):
    docs, queries = corpus
    known = spark.createDataFrame([(i, i, t, i % 2) for i, t in enumerate(docs)], "doc_id long, doc_pos long, text string, label int")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    R.save_index(R.build_index(known), str(tmp_path / "v1"))
    found = R.search_batch(asked, R.load_index(spark, str(tmp_path / "v1")))
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in found.collect()} == expected(docs, queries, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    scan = plan[: plan.index("MapInArrow")]  # above the blocks' scan only matches move
    assert "Join" not in plan and "Repartition" not in plan and plan.count("Relation [") == 1 and "Window" in scan


def test_reduced_copies_keep_the_latest(spark):
    df = spark.createDataFrame([(i, i, "same") for i in range(50)] + [(99, 99, "other")], "doc_id long, doc_pos long, text string")
    assert sorted(r["doc_id"] for r in M.reduce_copies(df, 3, ["text"]).collect()) == [47, 48, 49, 99]


def test_retrieval_decision_and_citations(spark):
    query = "unexpected error trying to delete block <block_id>"
    text = "info dfs.fsnamesystem: block added\n" + query + "\nunexpected error\nnothing here"
    matches = spark.createDataFrame(
        [("q", r, f"d{r}", 1, s, text) for r, s in ((1, .92), (2, .90), (3, .88))],
        "query_id string, rank int, doc_id string, label int, score double, evidence_text string")
    decision = R.retrieval_decision(matches).first()
    assert decision["recommendation"] == C.LIKELY_ANOMALY and decision["unanimous"]
    cited = R.cite_lines(matches.withColumn("query_text", F.lit(query)), 2).filter("doc_id = 'd1'").orderBy("line_rank").collect()
    assert len(cited) == 2 and cited[0]["score"] == 1.0 and cited[0]["template"] == query
    summary = R.evidence_summary(matches, 0.95).first()
    assert summary["recommendation"] == C.NEEDS_REVIEW and summary["anomaly_vote_ratio"] == 1.0


def test_tfidf_rows_have_unit_norm(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus[0])), "doc_id long, text string")
    terms = D.tfidf_terms(docs, D.fit_vocabulary(docs, D.RETRIEVAL))
    norms = terms.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1.0) for r in norms)


def test_tenants_share_ids_and_never_evidence(spark):
    from logsift.operators import investigation as I
    from logsift.plans import investigate as plan

    orgs, words = ("a", "b", None), {"a": "alpha", "b": "beta", None: "gamma"}
    empty, steps = F.array().cast("array<string>"), F.array(F.lit("look"))
    books = spark.createDataFrame([(o, "KB-1", 1, f"disk full {words[o]}", f"cause-{words[o]}") for o in orgs],
                                  "organization string, id string, doc_pos long, title string, root_cause string")
    books = books.select("*", F.lit("runbook").alias("kind"), F.lit("svc").alias("service"), F.lit("").alias("resolution"),
                         empty.alias("symptoms"), steps.alias("steps"), empty.alias("tags"))
    asked = spark.createDataFrame([(o, "i-1", "disk full") for o in orgs], "organization string, incident_id string, log_text string")
    events = asked.select("organization", "incident_id", F.lit(0).alias("pos"), F.lit("").alias("timestamp"), F.lit("svc").alias("service"),
                          F.lit("").alias("severity"), F.lit("disk full").alias("message"))
    deployments = spark.createDataFrame([("b", "d-1", "svc")], "organization string, id string, service string")
    done = plan.investigate(asked, events, books, deployments, semantic_weight=0.0, minimum_evidence=0.05, scope=("organization",))
    found = {(r.organization, r.incident_id): (r.id, r.title, r.root_cause) for r in done.evidence.collect()}
    assert found == {(o or "", "i-1"): ("KB-1", f"disk full {words[o]}", f"cause-{words[o]}") for o in orgs}
    assert {(r.organization, r.cause) for r in done.hypotheses.collect()} == {(o or "", f"cause-{words[o]}") for o in orgs}
    assert [(r.organization, r.deployments) for r in done.deployments.collect()] == [("b", 1)]
    assert done.checks.count() == 3
    flagged = I.affected_by_deployment(I.incident_summary(events.fillna(""), ["organization"]), deployments, ["organization"])
    assert {r.organization for r in flagged.filter("deployed").collect()} == {"b"}


def test_votes_and_citations_stay_in_their_scope(spark):
    """Two organizations that share incident, query, document and evidence ids."""
    from logsift.operators import investigation as I

    org = ("organization",)
    matches = spark.createDataFrame(
        [(o, "q", rank, f"d{rank}", 0.9, label) for o, label in (("a", 1), ("b", 0)) for rank in (1, 2, 3)],
        "organization string, query_id string, rank int, doc_id string, score double, label int")
    assert {(r.organization, r.recommendation) for r in R.retrieval_decision(matches, 0.5, scope=org).collect()} == {
        ("a", C.LIKELY_ANOMALY), ("b", C.LIKELY_NORMAL)}
    assert {(r.organization, r.anomaly_vote_ratio) for r in R.evidence_summary(matches, scope=org).collect()} == {("a", 1.0), ("b", 0.0)}
    evidence = spark.createDataFrame(
        [("a", "i", "KB-1"), ("b", "i", "KB-2"), (None, "i", "KB-3")], "organization string, incident_id string, id string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("kind", "title", "root_cause", "resolution", "steps")])
    outputs = spark.createDataFrame(
        [(o, "x", "i", "because", "low", cited) for o, cited in (("a", ["KB-1"]), ("b", ["KB-1", "KB-2"]), (None, ["KB-3"]), ("a2", ["KB-3"]))],
        "organization string, output_id string, incident_id string, explanation string, uncertainty string, cited_evidence_ids array<string>")
    checked = I.validate_citations(outputs, I.evidence_ledger(R.in_scope(evidence, org), org), org)
    assert {(r.organization, r.reason) for r in checked.collect()} == {("a", None), ("b", "outside ledger"), ("", None), ("a2", "outside ledger")}
    events = spark.createDataFrame([(o, "i", k, m) for o in "ab" for k, m in enumerate(("dns", "db query"))],
                                   "organization string, incident_id string, pos int, message string")
    causes = spark.createDataFrame([("a", "i", "network"), ("b", "i", "database")], "organization string, incident_id string, root_cause string")
    assert {(r.organization, r.pos) for r in R.keyword_evidence(events, causes, scope=org).collect()} == {("a", 0), ("b", 1)}
    pairs = spark.createDataFrame([(o, "q", "d", "disk failed on node", f"disk {o} failed") for o in "ab"],
                                  "organization string, query_id string, doc_id string, query_text string, evidence_text string")
    assert {(r.organization, r.template, r.line_rank) for r in R.cite_lines(pairs, scope=org).collect()} == {("a", "disk a failed", 1), ("b", "disk b failed", 1)}


def test_triage_in_scope(spark):
    """Incidents of two organizations share their ids; each meets its own evidence."""
    from dataclasses import replace

    from logsift.plans import holdout, triage as T

    kinds = {0: "service ok request served from cache", 1: "fatal error disk failed on node"}
    docs = spark.createDataFrame([(f"d{i}", i, f"{kinds[i % 2]} unit{i % 5} rack{i % 7}", i % 2) for i in range(80)],
                                 "doc_id string, doc_pos long, text string, label int")
    fitted = holdout.fit_triage(docs.filter("doc_pos < 60"), docs.filter("doc_pos >= 60"), conservative=False)
    flipped = docs.withColumn("label", 1 - F.col("label"))
    both = docs.withColumn("organization", F.lit("a")).unionByName(flipped.withColumn("organization", F.lit("b")))
    scoped = replace(fitted, index=T.evidence_index(fitted.model, both, ("organization",)))
    rows = T.assess(both.filter("doc_pos >= 70").select("organization", "doc_id", "text", "label"), scoped.model, scoped.index).collect()
    assert len(rows) == 20 and all(r.evidence_label == r.label and r.matches == 3 for r in rows)
    assert len({(r.doc_id, round(r.p, 9)) for r in rows}) == 10
    cited = T.cited_triage(both.filter("doc_pos >= 78"), scoped).collect()
    assert {(r.organization, r.query_id, r.label) for r in cited} == {(r.organization, r.doc_id, r.label) for r in rows if int(r.doc_id[1:]) >= 78}


def test_vectors_may_be_missing(spark):
    known = spark.createDataFrame([(0, 0, None), (1, 1, [1.0, 0.0]), (2, 2, None)], "doc_id long, doc_pos long, embedding array<double>")
    asked = spark.createDataFrame([(7, None), (8, [1.0, 0.0])], "query_id long, embedding array<double>")
    found = R.search_batch(asked, R.build_index(known, None), 2, semantic_weights=(1.0,)).collect()
    assert {(r.query_id, r.rank, r.doc_id, r.score) for r in found} == {(7, 1, 2, 0.0), (7, 2, 1, 0.0), (8, 1, 1, 1.0), (8, 2, 2, 0.0)}
    none = R.search_batch(asked.filter("query_id = 7"), R.build_index(known.filter("doc_id <> 1"), None), 1, semantic_weights=(1.0,)).collect()
    assert [(r.doc_id, r.score) for r in none] == [(2, 0.0)]


def test_cells_find_neighbours(spark):
    import numpy as np

    from logsift.operators import cells

    draw = np.random.default_rng(2)
    middles = draw.normal(size=(12, 8))
    unit = lambda x: (x / np.linalg.norm(x)).tolist()
    rows = [("a" if i // 12 % 3 else None, i, i, unit(middles[i % 12] + 0.2 * draw.normal(size=8)) if i % 50 else None) for i in range(600)]
    known = spark.createDataFrame(rows, "organization string, doc_id long, doc_pos long, embedding array<double>")
    asked = spark.createDataFrame([("a" if i % 2 else None, i, unit(middles[i % 12] + 0.2 * draw.normal(size=8)) if i else None) for i in range(40)],
                                  "organization string, query_id long, embedding array<double>")
    exact = R.search_batch(asked, R.build_index(known, None, scope=("organization",)), semantic_weights=(1.0,)).persist()
    index = cells.build_cells(known, 12, scope=("organization",))
    key = lambda df: {(r.organization, r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect()}
    assert key(cells.search_cells(asked, index, probes=12)) == key(exact)
    near = cells.search_cells(asked, index, probes=2)
    assert cells.recall(near, exact, ("organization",)).first()["recall"] >= 0.9
    assert index.packed.agg(F.sum("rows")).first()[0] == 600
    assert cells.search_cells(asked.limit(0), index, probes=2).collect() == []
    nothing = cells.build_cells(known.filter("doc_id < 0"), 4, scope=("organization",))
    assert cells.search_cells(asked, nothing, probes=2).collect() == []


@pytest.mark.parametrize("few", [50_000, 0])
def test_exact_quantiles(spark, monkeypatch, few):
    from logsift.operators import ordering
    from logsift.operators.ordering import exact_quantiles

    monkeypatch.setattr(ordering, "WINDOW_ROWS", few)

    values = [0.5, 0.5, 0.1, 0.9, None, 0.7, 0.2]
    df = spark.createDataFrame([(g, v) for g in "xy" for v in values[: 4 if g == "y" else None]], "g string, v double")
    found = {r.g: r.quantiles for r in exact_quantiles(df, "v", [0.0, 0.3, 1.0], ["g"]).collect()}
    assert found["x"] == pytest.approx([0.1, 0.35, 0.9]) and found["y"] == pytest.approx([0.1, 0.46, 0.9])
    assert exact_quantiles(df.filter("v > 5"), "v", [0.5]).collect() == []


def test_a_pair_of_blocks_carries_a_block_once(spark, monkeypatch):
    """Of the Cartesian product Python gets every block once a task; scopes are told apart there."""
    monkeypatch.setattr(M, "HELD_BYTES", 1 << 10)
    monkeypatch.setattr(M, "PASSING_BYTES", 1 << 40)
    block = lambda n, side: spark.range(n).selectExpr(
        "if(id % 2 = 0, 'a', 'b') AS organization", "id AS block", f"cast('{side}' AS binary) AS payload").repartition(3).persist()
    pairs = M._in_cells(block(10, "q"), block(6, "i"), ("organization",), 2 << 10, 1 << 20)
    parts = pairs.withColumn("part", F.spark_partition_id()).groupBy("part").agg(
        F.count("*").alias("pairs"), F.count("payload").alias("indexed"), F.count("_asked").alias("asked"),
        F.countDistinct("_index").alias("blocks"), F.countDistinct("_query").alias("queries")).collect()
    assert sum(p.pairs for p in parts) == 60 and len(parts) == 2  # the index is one part for each part of the queries
    assert all((p.indexed, p.asked) == (p.blocks, p.queries) for p in parts)


def test_frequent_terms_stay_where_they_were_counted(spark, monkeypatch):
    """Weights with rare terms joined apart equal those of one broadcast; no union makes Spark shuffle frequent terms."""
    from logsift.operators import ordering

    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(["node", "disk", "fault", f"unit{i % 7}", f"rack{i % 11}"]) for _ in range(9))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, "node disk fault"), (99, "alone")], "doc_id long, text string")
    found = []
    for most in (500_000, 12):
        monkeypatch.setattr(ordering, "BROADCAST_ROWS", most)
        vocabulary = D.fit_vocabulary(docs, D.RETRIEVAL)
        assert vocabulary.terms.count() > 12
        terms = D.tfidf_terms(docs, vocabulary)
        counts = D.term_counts(docs, D.RETRIEVAL, ["doc_id"])
        packed = D.vector_rows(docs.select("doc_id"), D.weigh_parts(counts, vocabulary, ["doc_id"]), ["doc_id"])
        assert "Union" not in packed._jdf.queryExecution().executedPlan().toString()
        found.append(({(r.doc_id, r.term): round(r.weight, 9) for r in terms.collect()},
                      {r.doc_id: {t: round(w, 9) for t, w in zip(r.term_ids or (), r.weights or ())} for r in packed.collect()},
                      {r.doc_id: {t: round(w, 9) for t, w in zip(r.term_ids, r.weights)} for r in D.tfidf(docs, vocabulary).collect()}))
    assert found[0] == found[1]
    long, packed, normed = found[0]
    assert (None, "node") in long and packed[99] == normed[99] == {}
    assert all(sum(w * w for w in v.values()) == pytest.approx(1.0) for v in normed.values() if v)


@pytest.mark.parametrize("kept", [64 << 20, 0])
def test_an_index_in_many_partitions_returns_few_rows(spark, monkeypatch, kept):
    """Sent queries leave k rows a task, and tasks follow the cores, not the partitions of the index."""
    monkeypatch.setattr(M, "UNPACKED_BYTES", kept)
    rows = [(i, i, [i % 7, 7 + i % 3], [1.0, 2.0]) for i in range(200)]
    index = M.pack_blocks(spark.createDataFrame(rows, "doc_id long, doc_pos long, term_ids array<long>, weights array<double>").repartition(40, "doc_id"), "doc_id")
    queries = M.pack_blocks(spark.createDataFrame([(i, [i], [1.0]) for i in range(5)], "query_id long, term_ids array<long>, weights array<double>"), "query_id", most_rows=2)
    found = []
    monkeypatch.setattr(M, "top_per_group", lambda df, *a, f=M.top_per_group: (found.append(df), f(df, *a))[1])
    monkeypatch.setattr(M, "_packed_bytes", lambda blocks: 1)
    best = {(r.query_id, r["rank"]): r.doc_id for r in M.match_blocks(queries, index, 2).collect()}
    assert index.rdd.getNumPartitions() == 40 > 2 * spark.sparkContext.defaultParallelism >= found[0].rdd.getNumPartitions()
    for i in range(5):
        assert [best[i, 1], best[i, 2]] == [j for j in range(199, -1, -1) if j % 7 == i][:2]


def test_a_dense_search_makes_no_other_scores(monkeypatch):
    """Of weight one the inner products are the scores: nothing is blended."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(3)
    sides = [draw.standard_normal((n, 5)) for n in (30, 8)]
    blocks = [M._Block(M._payload(pa.table({name: pa.array(range(len(v))), "embedding": pa.array(v.tolist(), pa.list_(pa.float64())), **more}), name))
              for v, name, more in zip(sides, ("doc_id", "query_id"), ({"doc_pos": pa.array(range(30))}, {}))]
    seen, best = [], M._best
    monkeypatch.setattr(M, "_best", lambda scores, k: (seen.append(scores), best(scores, k))[1])
    products = []
    blocks[1].vectors = type("V", (np.ndarray,), {"__matmul__": lambda a, b: (products.append(np.asarray(a) @ np.asarray(b)), products[-1])[1]})(
        blocks[1].vectors.shape, buffer=blocks[1].vectors.copy())
    matcher = M._Matcher(3, (1.0,))
    matcher.add(blocks[1], blocks[0], None)
    assert len(seen) == 1 and seen[0] is products[0]
    (table,) = list(matcher.result([], (), []))
    found = {}
    for r in table.to_pylist():
        found.setdefault(r["query_id"], []).append(r["doc_id"])
    scores = sides[1] @ sides[0].T
    assert found == {i: np.argsort(-scores[i], kind="stable")[:3].tolist() for i in range(8)}


def test_norms_move_only_rare_terms(spark, monkeypatch):
    """Frequent terms are normed where they were counted; only rows of rare ones return to their document."""
    from logsift.operators import ordering

    monkeypatch.setattr(ordering, "BROADCAST_ROWS", 12)
    rows = [(i, f"node disk unit{i % 7} rack{i % 11} slot{i % 19}") for i in range(60)] + [(None, "node disk"), (99, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = D.term_counts(docs, D.RETRIEVAL, ["doc_id"]).persist()
    vocabulary = D.vocabulary_from_counts(counts, docs, D.RETRIEVAL)
    assert vocabulary.terms.count() > 12
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # rare terms are shuffled, as many are
    try:
        terms = D.tfidf_terms(docs, vocabulary, counts=counts)
        found = {(r.doc_id, r.term): r.weight for r in terms.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = [line.strip(" +-:*()0123456789") for line in terms._jdf.queryExecution().executedPlan().toString().splitlines()]
    window = next(i for i, line in enumerate(plan) if line.startswith("Window"))
    above = plan[window + 1 : next(i for i, line in enumerate(plan) if line.startswith("Union"))]
    assert above and not any("Exchange" in line or "Shuffle" in line for line in above)
    expected = brute_vectors([t for _, t in rows], [t for _, t in rows], 2, True)
    assert found == {(i, t): pytest.approx(w) for (i, _), vector in zip(rows, expected) for t, w in vector.items()}


def test_a_block_of_held_queries_is_unpacked_once(monkeypatch):
    """Not again for every block of the index that passes."""
    import numpy as np
    import pyarrow as pa

    def payload(name, **more):
        terms = pa.array([[1, 2], [2, 3], [3]], pa.list_(pa.int64()))
        return M._payload(pa.table({name: pa.array([0, 1, 2]), "term_ids": terms, "weights": pa.array([[1.0, 1.0], [1.0, 2.0], [1.0]]), **more}), name)

    asked = payload("query_id")
    blocks = [payload("doc_id", doc_pos=pa.array([10 * n, 10 * n + 1, 10 * n + 2])) for n in range(4)]
    batch = pa.table({"_index": pa.array(range(4)), "payload": pa.array(blocks, pa.binary()), "_query": pa.array([0] * 4),
                      "_asked": pa.array([asked, None, None, None], pa.binary())}).to_batches()[0]
    unpacked = []
    monkeypatch.setattr(M, "_Block", lambda p, made=M._Block: (unpacked.append(bytes(p)), made(p))[1])
    (found,) = M._in_cell(2, (0.0,), ())(iter([batch]))
    assert unpacked.count(asked) == 1 and len(unpacked) == 5
    best = {}
    for r in found.to_pylist():
        best.setdefault(r["query_id"], []).append(r["doc_pos"])
    assert best == {0: [30, 20], 1: [31, 21], 2: [32, 22]} and np.allclose(found.column("score").to_numpy(), 1.0)
