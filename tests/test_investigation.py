import pytest
from pyspark.sql import functions as F

from logsift import constants as C, schemas as S
from logsift.operators import audit, investigation as I
from logsift.operators import metrics as H
from logsift.plans.investigate import configuration_trials, investigate

KNOWLEDGE = [
    ("INC-1", "incident", "Payment database connection pool exhaustion", "payment-api",
     ["database connection timeout", "connection pool exhausted"], "database_connection_pool_exhaustion",
     "Raised the pool size.", [], ["database", "pool"]),
    ("INC-2", "incident", "Checkout dns failure", "checkout-api", ["dns resolution failure", "host not found"],
     "dns_or_network_failure", "Restored the resolver.", [], ["dns"]),
    ("BOOK-1", "runbook", "Database connectivity checks", "shared", ["database timeout", "connection pool exhausted"],
     None, None, ["Check availability.", "Compare pool use."], ["database", "pool"]),
]


def inputs(spark):
    knowledge = spark.createDataFrame(
        [(i, *k) for i, k in enumerate(KNOWLEDGE)],
        "doc_pos bigint, id string, kind string, title string, service string, symptoms array<string>, "
        "root_cause string, resolution string, steps array<string>, tags array<string>")
    events = spark.createDataFrame(
        [("a", 0, "t2", "payment-api", "", "Database connection timeout 17"), ("a", 1, "t1", "payment-api", "", "connection pool exhausted"),
         ("a", 2, "", "web", "", "Database connection timeout 18"), ("b", 0, "t1", "web", "", "all quiet")],
        "incident_id string, pos int, timestamp string, service string, severity string, message string")
    incidents = spark.createDataFrame(
        [("a", "database connection timeout 17 connection pool exhausted database connection timeout 18", "LIKELY_ANOMALY"),
         ("b", "all quiet", "NEEDS_HUMAN_REVIEW")], "incident_id string, log_text string, triage_recommendation string")
    deployments = spark.createDataFrame([("d1", "payment-api", "x"), ("d2", "orders-api", "y")], "id string, service string, summary string")
    return incidents, events, knowledge, deployments


def test_pool_exhaustion_comes_first(spark):
    done = investigate(*inputs(spark), semantic_weight=0.0)
    summary = {r["incident_id"]: r for r in done.summary.collect()}
    assert summary["a"]["affected_service"] == "payment-api" and summary["a"]["event_count"] == 3
    assert (summary["a"]["first_seen"], summary["a"]["last_seen"], summary["a"]["error_count"]) == ("t1", "t2", 2)
    errors = done.errors.filter("incident_id = 'a'").orderBy("rank").collect()
    assert (errors[0]["template"], errors[0]["n"]) == ("database connection timeout <num>", 2)
    first = done.hypotheses.filter("rank = 1").collect()
    assert [(r["incident_id"], r["cause"]) for r in first] == [("a", "database_connection_pool_exhaustion")]
    assert "INC-1" in first[0]["evidence_ids"]
    checks = done.checks.orderBy("rank").collect()
    assert [r["step"] for r in checks] == ["Check availability.", "Compare pool use."]
    assert {r["source_id"] for r in checks} == {"BOOK-1"}
    assert done.deployments.count() == 1
    decisions = {r["incident_id"]: r for r in done.decisions.collect()}
    assert decisions["b"]["decision"] == C.ENGINEER_REVIEW and decisions["b"]["triage_recommendation"] == C.NEEDS_REVIEW


def test_citations_outside_the_ledger_are_rejected(spark):
    ledger = spark.createDataFrame([("a", "INC-1")], "incident_id string, id string")
    outputs = spark.createDataFrame(
        [(1, "a", "because", "some", ["INC-1"]), (2, "a", "because", "some", ["INVENTED-1"]), (3, "a", " ", "some", ["INC-1"])],
        "output_id int, incident_id string, explanation string, uncertainty string, cited_evidence_ids array<string>")
    got = {r["output_id"]: r["reason"] for r in I.validate_citations(outputs, ledger).collect()}
    assert got == {1: None, 2: "outside ledger", 3: "incomplete"}


def test_tenant_knowledge(spark):
    services = spark.createDataFrame([(" pay ", "d", "team", ["db", "db", " "])], S.SERVICE)
    docs = spark.createDataFrame([(" X ", "incident", " t ", None, ["a", "a "], None, None, None, None)], S.KNOWLEDGE)
    rows = {r["id"]: r for r in I.tenant_knowledge(services, docs).collect()}
    assert rows["ARCH-pay"]["tags"] == ["pay", "team", "db"] and rows["ARCH-pay"]["dependencies"] == ["db"]
    assert rows["X"]["service"] == "shared" and rows["X"]["symptoms"] == ["a"]


def test_upsert_counts_versions(spark):
    now, old = (F.lit(t).cast("timestamp") for t in ("2025-01-01", "2024-01-01"))
    current = spark.createDataFrame([("a", "A", 4), ("b", "B", 1)], "organization_id string, display_name string, knowledge_version int").withColumn(
        "created_at", old).withColumn("updated_at", old)
    incoming = spark.createDataFrame([("a", "A1", 1), ("a", "A2", 2), ("c", "C", 1)], "organization_id string, display_name string, seq int")
    rows = {r["organization_id"]: r for r in audit.upsert_profiles(current, audit.last_per_key(incoming, "organization_id", "seq"), now).collect()}
    assert {k: (r["display_name"], r["knowledge_version"]) for k, r in rows.items()} == {"a": ("A2", 5), "b": ("B", 1), "c": ("C", 1)}
    assert rows["a"]["created_at"] < rows["a"]["updated_at"] and rows["b"]["updated_at"] == rows["b"]["created_at"]


def test_configuration_search_runs_all_trials(spark):
    incidents, events, knowledge, deployments = inputs(spark)
    vector = F.array(F.lit(1.0), F.lit(0.0))
    cases = incidents.select(
        "incident_id", "log_text", vector.alias("embedding"), F.lit(C.ENGINEER_REVIEW).alias("decision"), F.lit("INC-1").alias("expected_evidence_id"),
        F.when(F.col("incident_id") == "a", "database_connection_pool_exhaustion").alias("expected_root_cause"))
    embedded = knowledge.withColumn("embedding", F.when(F.col("kind") == "incident", F.array(F.lit(0.6), F.lit(0.8))))
    trials = configuration_trials(cases, events, embedded, deployments).collect()
    assert {(t["semantic_weight"], t["minimum_evidence"]) for t in trials} == {(w, e) for w in C.INVESTIGATION_WEIGHTS for e in C.INVESTIGATION_EVIDENCE}
    assert all(t["known_cases"] == 1 and t["unknown_cases"] == 1 for t in trials)
    best = H.select_investigation_config(spark.createDataFrame(trials)).first()
    top = max(0.5 * t["unknown_abstention_rate"] + 0.35 * t["known_top_1_accuracy"] + 0.15 * (t["known_hypothesis_precision"] or 0) for t in trials)
    assert abs(best["objective"] - top) < 1e-9


@pytest.mark.parametrize("most", [8 << 20, 400])
def test_keyword_hits_of_many_keywords(spark, monkeypatch, most):
    monkeypatch.setattr(I, "KEYWORD_BYTES", most)
    number = 100_000 if most > 400 else 60
    words = spark.range(number).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("organization"),
        F.concat(F.lit("cause-"), (F.col("id") % 7).cast("string")).alias("cause"), F.concat(F.lit("kw"), F.col("id").cast("string")).alias("word"))
    texts = [("a", "i1", "kw2 xkw20y kw20 kw3 nothing", ["cause-2", "cause-6", "cause-5"]), ("b", "i1", "kw3kw5 kw59", ["cause-3", "cause-5"]),
             ("b", "i2", "", ["cause-3"]), ("a", "i3", None, ["cause-0"]), ("a", "i4", "kw2", None), ("c", "i5", "kw2", ["cause-2"])]
    rows = spark.createDataFrame(texts, "organization string, incident_id string, text string, wanted array<string>")
    found = {(r.organization, r.incident_id, r.cause): r.hits for r in I.keyword_hits(rows, words, ["incident_id"], ["organization"]).collect()}
    own = {}
    for k in range(min(number, 1000)):
        own.setdefault(("ab"[k % 2], f"cause-{k % 7}"), []).append(f"kw{k}")
    assert found == {(o, i, c): sum(w in (t or "") for w in own.get((o, c), [])) for o, i, t, wanted in texts for c in wanted or []}
    assert I.keyword_hits(rows.limit(0), words, ["incident_id"], ["organization"]).collect() == []
    assert {r.hits for r in I.keyword_hits(rows, words.limit(0), ["incident_id"], ["organization"]).collect()} == {0}


def test_retrieval_baseline_reads_every_word(spark, tmp_path):
    """words that are stop words elsewhere decide too."""
    from checks import section_fgh

    spark.createDataFrame([(0, "this is what they have been"), (2, "disk node")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, "user", "what have they been")], "conv_id long, turn int, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    found = section_fgh.QUERIES["h13_retrieval_baseline"](spark, str(tmp_path)).collect()
    assert [(r.incident_id, r.predicted_cause) for r in found] == [("100000", "cause-0")]
    assert "NOT list_contains" not in section_fgh.ORACLES["h13_retrieval_baseline"].split("iq_fit AS")[1]
