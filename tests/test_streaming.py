from pyspark.sql import functions as F

from logsift.operators import audit
from logsift.streaming import counters, triage, windows


def stream_of(spark, df, path, files=3):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("i", "s"), ("j", "s")], "incident_id string, source string")
    for _ in range(2):
        audit.append_decisions(rows, str(tmp_path / "t"), "1")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(90).select(F.col("id").cast("string").alias("incident_id"), F.lit("s").alias("source"))
    query = triage.stream_decisions(
        stream_of(spark, df, str(tmp_path / "in")), lambda b: b, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("incident_id").distinct().count() == 90


def test_count_windows_on_a_stream(spark, tmp_path):
    df = spark.range(50).select(
        (F.col("id") % 2).cast("string").alias("key"), "id", F.col("id").cast("string").alias("message"),
        (F.col("id") == 6).cast("int").alias("is_alert"))
    source = str(tmp_path / "in")
    for lo in (0, 25):  # later files hold later lines
        df.filter((F.col("id") >= lo) & (F.col("id") < lo + 25)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = windows.stream_count_windows(stream, "key", "id", size=10)
    query = out.writeStream.format("memory").queryName("counted").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    rows = {(r["key"], r["window_number"]): r for r in spark.table("counted").collect()}
    assert sorted(rows) == [("0", 0), ("0", 1), ("1", 0), ("1", 1)]
    assert rows["0", 0]["is_anomaly"] == 1 and rows["0", 1]["text"].split("\n")[0] == "20"


def test_counters_on_a_table(spark):
    rows = spark.createDataFrame([("2026-01-01 00:10:00", "s", "r"), ("2026-01-01 00:50:00", "s", "r")], "t string, source string, recommendation string")
    got = counters.windowed_counters(rows.withColumn("created_at", F.col("t").cast("timestamp"))).collect()
    assert [r["requests"] for r in got] == [2]
    latency = counters.windowed_latency(rows.select(F.col("t").cast("timestamp").alias("created_at"), F.lit(0.3).alias("seconds"))).first()
    assert latency["le_0_25"] == 0 and latency["le_0_5"] == 2 and latency["le_inf"] == 2


def test_streamed_triage_equals_batch_triage(spark, tmp_path):
    from logsift.plans import holdout
    from logsift.plans.triage import cited_triage, triage as decide

    kinds = {0: "service ok request served from cache", 1: "fatal error disk failed on node"}
    docs = spark.createDataFrame(
        [(f"d{i}", i, f"{kinds[i % 2]} unit{i % 5} rack{i % 7}", i % 2) for i in range(120)], "doc_id string, doc_pos long, text string, label int")
    fitted = holdout.fit_triage(docs.filter("doc_pos < 60"), docs.filter("doc_pos between 60 and 89"), conservative=False)
    later = docs.filter("doc_pos >= 90").select("doc_id", "text")
    query = triage.stream_triage(stream_of(spark, later, str(tmp_path / "in")), fitted, str(tmp_path / "out"), str(tmp_path / "ck"), "stream")
    query.awaitTermination()
    streamed = {(r.incident_id, r.recommendation, round(r.top_similarity, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {(r.doc_id, r.recommendation, round(r.top_similarity, 9)) for r in decide(later, fitted).collect()} and len(streamed) == 30
    cited = cited_triage(later.limit(3), fitted).collect()
    assert {r.query_id for r in cited} == {r.doc_id for r in later.limit(3).collect()} and all(r.template for r in cited)
