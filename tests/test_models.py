import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift import constants as C
from logsift.operators import audit, features as D, models as M, policy as P, retrieval as R
from logsift.plans import feedback


def docs(spark, n=40):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.col("id").alias("doc_pos"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("fatal error node r"), (F.col("id") % 5)))
        .otherwise(F.concat(F.lit("health check passed r"), (F.col("id") % 7))).alias("text"),
        (1 - F.col("id") % 2).cast("int").alias("label"))


def test_features_of_both_ways_are_equal(spark):
    rows = docs(spark, 40).select("doc_id", F.when(F.col("doc_id") == 3, "").when(F.col("doc_id") == 4, "unseen words").otherwise(F.col("text")).alias("text"))
    vocabulary, size = D.numbered_vocabulary(D.fit_vocabulary(rows.filter("doc_id <> 4"), D.FOREST))
    packed = {r.doc_id: r.features.toArray() for r in D.to_sparse(D.tfidf(rows, vocabulary), size).collect()}
    counted = D.jvm_features(rows, vocabulary, size)
    found = {r.doc_id: r.features.toArray() for r in counted.collect()}
    assert found.keys() == packed.keys() and all(np.allclose(found[i], packed[i], atol=1e-12) for i in packed)
    assert "Python" not in counted._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        D.jvm_features(rows, D.fit_vocabulary(rows, D.RETRIEVAL), 10)


def test_logistic_equals_direct_solution(spark):
    rows = docs(spark, 30).filter("doc_id % 3 > 0").persist()
    space = M.fit_space(rows, D.RETRIEVAL)
    data = D.class_weights(M.featurize(rows, space).join(rows.select("doc_id", "label"), "doc_id"))
    model = M.fit_logistic(data)
    local = data.select("features", "label", "weight").collect()
    x = np.array([np.append(r["features"].toArray(), 1.0) for r in local])
    y, w = np.array([r["label"] for r in local]), np.array([r["weight"] for r in local])
    beta, penalty = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (w * (p - y)) + penalty * beta
        beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
    assert np.abs(model.coefficients.toArray() - beta[:-1]).max() < 1e-3
    assert abs(model.intercept - beta[-1]) < 1e-3


def test_classifier_separates_and_forest_ranks(spark):
    rows = docs(spark).persist()
    model = M.train_text_classifier(rows, D.DEMO)
    scored = M.score(model, rows).join(rows, "doc_id").collect()
    assert all((r["p"] >= 0.5) == (r["label"] == 1) for r in scored)
    caused = rows.filter("label = 1").withColumn("root_cause", F.when(F.col("doc_id") % 5 < 2, "database").otherwise("network"))
    ranked = M.rank_causes(M.fit_cause_model(caused, trees=10), caused)
    assert ranked.filter("rank = 1").count() == 20
    total = ranked.groupBy("doc_id").agg(F.sum("probability").alias("t")).collect()
    assert all(r["t"] == pytest.approx(1.0) for r in total)


def test_isolation_forest_scores_strangers_higher(spark):
    normal = docs(spark, 200).filter("label = 0").select("doc_id", "text")
    space = M.fit_space(normal.unionByName(spark.createDataFrame([(900, "odd odd words"), (901, "odd odd words")], "doc_id long, text string")), D.FOREST)
    packed = D.tfidf(normal, space.vocabulary)
    forest = M.fit_isolation_forest(packed, trees=20)
    assert forest.select("tree").distinct().count() == 20
    assert forest.filter("node = 0").agg(F.max("size")).first()[0] <= 256
    scores = M.isolation_scores(packed, forest)
    assert 0 < scores.agg(F.min("score")).first()[0] and scores.agg(F.max("score")).first()[0] < 1


def test_feedback_candidate(spark):
    rows = spark.range(24).select(
        F.col("id").cast("string").alias("incident_id"),
        F.array(F.struct(F.when(F.col("id") % 2 == 0, " fatal kernel panic ").otherwise("request completed ok").alias("message"))).alias("incident_events"),
        F.when(F.col("id") % 2 == 0, "ANOMALY").otherwise("NORMAL").alias("final_anomaly_label"),
        F.format_string("2026-01-%02d", F.col("id") + 1).alias("created_at"))
    _, report = feedback.feedback_candidate(audit.learning_examples(rows))
    assert report["training_examples"] + report["test_examples"] == 24
    assert report["test_f1"] == 1.0 and report["promotion_status"] == C.HUMAN_APPROVAL
    with pytest.raises(ValueError):
        feedback.feedback_candidate(audit.learning_examples(rows), minimum_per_class=13)


def test_analyze_needs_evidence(spark):
    rows = spark.createDataFrame([(1, .9, "network", .9, 2), (2, .9, "network", .9, 0), (3, .9, "network", .6, 2)],
                                 "id int, anomaly_p double, cause string, cause_p double, evidence_count int")
    got = {r["id"]: (r["decision"], r["root_cause"]) for r in P.analyze_decision(rows).collect()}
    assert got == {1: ("ANALYZED", "network"), 2: (C.NEEDS_REVIEW, None), 3: (C.NEEDS_REVIEW, None)}


def test_keyword_evidence_order(spark):
    events = spark.createDataFrame([("i", 0, "ok"), ("i", 1, "DNS failure"), ("i", 2, "packet to upstream"), ("i", 3, "dns"), ("i", 4, "dns")],
                                   "incident_id string, pos int, message string")
    causes = spark.createDataFrame([("i", "network")], "incident_id string, root_cause string")
    assert [r["pos"] for r in R.keyword_evidence(events, causes).orderBy("rank").collect()] == [2, 1, 3]


def test_equal_texts_are_judged_once(spark, monkeypatch):
    """Models and evidence see a text once; every row of every id gets its result, ids with several texts their own."""
    from logsift.plans import triage as T

    known = docs(spark, 60).persist()
    model = M.train_text_classifier(known, D.RETRIEVAL)
    index = T.evidence_index(model, known)
    asked = spark.createDataFrame(
        [(i, f"fatal error node r{i % 2}") for i in range(30)] + [(30, "health check passed r1"), (30, "fatal error node r1"), (31, None), (None, "lost"), (31, None)],
        "doc_id long, text string").persist()
    plain = {r.doc_id: r.p for r in M.score_each(model, asked.filter("doc_id IS NOT NULL")).collect()}
    seen, each = [], M.score_each
    monkeypatch.setattr(M, "score_each", lambda m, texts, name="p": (seen.append(texts.count()), each(m, texts, name))[1])
    scored = M.score(model, asked).collect()
    assert seen == [2 + 2 + 2] and len(scored) == 30 + 2 + 2
    assert all(abs(r.p - plain[r.doc_id]) < 1e-12 for r in scored) and {r.doc_id for r in scored} == set(range(32))
    votes = {r.doc_id: r.asDict() for r in T.evidence_votes(asked, index).collect()}
    rows = T.assess(asked, model, index).collect()
    assert len(rows) == 30 + 4 + 4  # rows of one id meet each other, as before
    assert all(abs(r.p - plain[r.doc_id]) < 1e-12 and (r.top_similarity, r.anomaly_votes, r.evidence_label) == tuple(
        votes[r.doc_id][c] for c in ("top_similarity", "anomaly_votes", "evidence_label")) for r in rows)


def test_a_repeated_text_is_one_weighted_row(spark, monkeypatch):
    """Training rows of one text and label are fitted as one row of their weight; the optimum stays."""
    seen = []
    monkeypatch.setattr(M, "fit_logistic", lambda data, f=M.fit_logistic: (seen.append((data.count(), data.agg(F.sum("weight")).first()[0])), f(data))[1])
    rows = docs(spark, 70).persist()
    space = M.fit_space(rows, D.RETRIEVAL)
    model = M.train_text_classifier(rows, D.RETRIEVAL, space)
    assert seen[0][0] == rows.select("text").distinct().count() == 12 and seen[0][1] == pytest.approx(70)
    data = M.balanced(M.featurize(rows, space).join(rows.select("doc_id", "label"), "doc_id"))
    from pyspark.ml.classification import LogisticRegression

    plain = LogisticRegression(weightCol="weight", maxIter=1000, tol=1e-6, regParam=1 / 70, elasticNetParam=0.0, standardization=False, family="binomial").fit(data)
    assert np.allclose(plain.coefficients.toArray(), model.classifier.coefficients.toArray(), atol=1e-3)


@pytest.mark.parametrize("unit", ["packed", "weights", "vector"])
def test_a_length_is_summed_once(spark, unit):
    """Not again for each weight, which made long texts a square of their terms (F14 to F16, F18 to F20; vectors F4, F11 to F13)."""
    from logsift.functions import vectors as V

    if unit == "packed":
        rows = docs(spark)
        found = D.tfidf(rows, D.fit_vocabulary(rows, D.RETRIEVAL)).select(F.col("doc_id").alias("id"), F.col("weights").alias("v"))
    else:
        rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, None), (2, []), (3, [1.0] * 9)], "id long, v array<double>")
        found = rows.select("id", (V.unit_vector if unit == "vector" else V.unit_weights)(F.col("v")).alias("v"))
    for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert "aggregate(" not in line.partition("transform(")[2]
    vectors = {r.id: r.v for r in found.collect()}
    assert len(vectors) == rows.count() and all(sum(x * x for x in v) == pytest.approx(1.0) for v in vectors.values() if v)
    if unit != "packed":
        assert vectors[0] == [0.6, 0.8] and vectors[1] is None and vectors[2] == []
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(V.unit_vector(F.col("v")).alias("v")).first()
    assert zero.v == [0.0, 0.0]
