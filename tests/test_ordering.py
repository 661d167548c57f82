"""Line numbers from file offsets, as-of joins, joins with frequent keys."""

import random

import pytest
from pyspark.sql import functions as F

from logsift.operators import features as D, investigation as I, ordering as O, windows as W
from logsift.sources import readers


@pytest.fixture
def small_splits(spark):
    """Files are read in many splits."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_line_numbers_of_many_files_and_splits(spark, tmp_path, small_splits):
    draw, expected = random.Random(3), []
    for k in range(4):
        lines = [draw.choice(["", "   ", f"line {k} {i} " + "x" * draw.randint(0, 60)]) for i in range(150 if k != 2 else 0)]
        (tmp_path / f"part-{k}.log").write_text("\n".join(lines) + ("\n" if lines else ""))
        expected += [x.strip() for x in lines if x.strip()]
    found = readers.numbered_log_lines(spark, str(tmp_path))
    assert found.select("file", "block").distinct().count() > 9
    assert [r.value for r in found.orderBy("line").collect()] == expected
    assert [r.line for r in found.orderBy(*readers.LOG_ORDER).collect()] == list(range(len(expected)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Sort" not in plan


def test_windows_over_files(spark, tmp_path, small_splits):
    values = [f"{'KERN' if i % 31 == 0 else '-'} 1 2 node{i % 7} 3 node RAS KERNEL INFO message {i}" for i in range(205)]
    for k in range(3):
        (tmp_path / f"{k}.log").write_text("\n\n".join(values[k * 70 : (k + 1) * 70]) + "\n")
    numbered = W.count_windows(W.alert_events(readers.numbered_log_lines(spark, str(tmp_path))), number="line")
    rows = spark.createDataFrame(list(enumerate(values)), "i int, value string")
    sorted_ = W.count_windows(W.alert_events(rows), F.col("i"))
    key = lambda df: sorted((r.incident_id, r.is_anomaly, [e.message for e in r.events]) for r in df.collect())
    assert key(numbered) == key(sorted_) and len(key(numbered)) == 10


def test_last_deployment_before(spark):
    draw = random.Random(5)
    incidents = [(draw.choice(["a", "b", None]), f"i{k}", draw.choice(["hot", "hot", "hot", "x", "none"]), f"2024-01-{draw.randint(1, 28):02}") for k in range(300)]
    incidents += [("a", "no-time", "hot", None)]
    releases = [(draw.choice(["a", "b", None]), f"d{k:03}", draw.choice(["hot", "hot", "x"]), f"2024-01-{draw.randint(3, 28):02}") for k in range(60)] + [("a", "d-null", "hot", None)]
    summary = spark.createDataFrame(incidents, "organization string, incident_id string, affected_service string, first_seen string").repartition(7)
    deployments = spark.createDataFrame(releases, "organization string, id string, service string, deployed_at string").repartition(5)
    found = I.last_deployments(summary, deployments, ("organization",)).collect()
    assert len(found) == len(incidents)
    for r in found:
        past = [(at, d) for o, d, s, at in releases if (o or "") == r.organization and s == r.service and at and r.first_seen and at <= r.first_seen]
        assert (r.deployed_at, r.deployment_id) == (max(past) if past else (None, None))
    plain = I.last_deployments(summary.drop("organization"), deployments.drop("organization").filter("id < 'd'")).collect()
    assert len(plain) == len(incidents) and all(r.deployment_id is None for r in plain)


@pytest.mark.parametrize("limit", [0, 7, 40])
def test_frequent_terms_are_broadcast_and_rare_ones_shuffled(spark, monkeypatch, limit):
    draw = random.Random(1)
    words = [f"w{k}" for k in range(120)]
    docs = spark.createDataFrame([(i, " ".join(["every"] + draw.choices(words, k=8))) for i in range(80)], "doc_id long, text string")
    expected = {r.doc_id: dict(zip(r.term_ids, r.weights)) for r in D.tfidf(docs, D.fit_vocabulary(docs, D.RETRIEVAL)).collect()}
    monkeypatch.setattr(O, "BROADCAST_ROWS", limit)
    found = {r.doc_id: dict(zip(r.term_ids, r.weights)) for r in D.tfidf(docs, D.fit_vocabulary(docs, D.RETRIEVAL)).collect()}
    assert found.keys() == expected.keys()
    for i, terms in expected.items():
        assert found[i] == pytest.approx(terms)
