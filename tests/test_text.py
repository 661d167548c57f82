import re

import pytest
from pyspark.sql import functions as F

from logsift.functions import text as X
from logsift.operators import windows


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize("line, present, absent", [
    ("081111 042720 19510 WARN dfs.FSDataset: Unexpected error trying to delete block "
     "blk_2719230260348020339 src: /10.251.203.179:50010",
     ["<block_id>", "<ip_port>", "unexpected error trying to delete block"],
     ["2719230260348020339", "10.251.203.179", "081111"]),
    ("- 1117838570 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.363779 "
     "R02-M1-N0-C:J12-U11 RAS KERNEL FATAL data storage interrupt",
     ["<date>", "<timestamp>", "<node>", "ras kernel fatal data storage interrupt"],
     ["1117838570", "R02"]),
    ("addr 0xDEADbeef at 10.0.0.1 count 12345 small 42", ["<hex>", "<ip>", "<number>", "small 42"], ["12345"]),
])
def test_cross_domain_masks(spark, line, present, absent):
    masked = one(spark, line, X.normalize_cross_domain)
    for part in present:
        assert part in masked
    for part in absent:
        assert part.lower() not in masked


def test_masks_equal_python_regex(spark):
    """The look-behind forms give what the plain word-boundary patterns give."""
    samples = [
        "x/1.2.3.4:80 y1.2.3.4 _1.2.3.4:9 é123 123é 123 12 1234", "blk_1 xblk_22 blk_-33_4 (blk_44)",
        "0x1F a0x1F 0xZZ 0x12g", "\t 081111 042720 19 a b　 c  ", "R1-M0-NB-C:J1-U2 xR1-M0-N1-C:J1-U2",
        "2005-06-03-15.42.50 2005.06.03 12005.06.03", "//10.0.0.1:1 /10.0.0.1/ 999.999.999.999:0",
    ]

    def expected(text):
        text = re.sub(r"^\d{6}\s+\d{6}\s+\d+\s+", "", text.strip())
        for pattern, label in [
            (r"\bblk_-?\d+\b", "<block_id>"),
            (r"\b\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}(?:\.\d+)?\b", "<timestamp>"),
            (r"\b\d{4}\.\d{2}\.\d{2}\b", "<date>"),
            (r"\bR\d+-M\d+-(?:N\d+|NB|NE)-C:J\d+-U\d+\b", "<node>"),
            (r"/?\b(?:\d{1,3}\.){3}\d{1,3}:\d+\b", "<ip_port>"), (r"/?\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
            (r"\b0x[0-9a-fA-F]+\b", "<hex>"), (r"\b\d{3,}\b", "<number>"),
        ]:
            text = re.sub(pattern, label, text)
        return re.sub(r"\s+", " ", text).strip().lower()

    rows = spark.createDataFrame([(s,) for s in samples], "v string").select(
        "v", X.normalize_cross_domain(F.col("v")).alias("n")).collect()
    assert {r["v"]: r["n"] for r in rows} == {s: expected(s) for s in samples}


def test_alert_line_hides_the_label(spark):
    df = spark.createDataFrame(
        [("- 1 2005 a  b",), ("KERNDTLB 2 2005 c d",), ("one two",), ("  ",), ("solo",)], "value string")
    rows = [r.asDict() for r in windows.alert_events(df).collect()]
    assert [r["message"] for r in rows] == ["2005 a  b", "2005 c d", "one two", "solo"]
    assert [r["is_alert"] for r in rows] == [0, 1, 1, 1]
    assert [r["timestamp"] for r in rows] == ["- 1", "KERNDTLB 2", "one two", "unknown"]
    assert "KERNDTLB" not in rows[1]["message"]


def test_incident_text_modes(spark):
    events = F.array(*[F.struct(F.lit(m).alias("message")) for m in ("A 1234", "", "b")])
    row = spark.range(1).select(*[
        X.incident_text(events, m).alias(m) for m in
        ("raw_space", "lower_space", "raw_newline", "normalized_newline", "cross_domain_newline")]).first()
    assert row["raw_space"] == "A 1234  b" and row["raw_newline"] == "A 1234\nb"
    assert row["normalized_newline"] == "a <number>\nb" == row["cross_domain_newline"]
    with pytest.raises(ValueError):
        X.incident_text(events, "other")


def test_sequences_and_keys(spark):
    row = spark.createDataFrame([("E5,E22,E5",)], "f string").select(
        X.padded_sequence(X.event_id_sequence(F.col("f")), 5).alias("p"),
        X.padded_sequence(X.event_id_sequence(F.col("f")), 2).alias("q"),
        X.window_order_key(F.lit("bgl-window-001234")).alias("k"),
        X.window_order_key(F.lit("other")).alias("none"), X.window_id(F.lit(12)).alias("id")).first()
    assert (row["p"], row["q"], row["k"], row["none"]) == ([5, 22, 5, 0, 0], [5, 22], 1234, None)
    assert row["id"] == "bgl-window-000012"


def test_bigrams(spark):
    row = spark.range(1).select(
        X.with_bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("three"),
        X.with_bigrams(F.array(F.lit("a"))).alias("one"),
        X.with_bigrams(F.array().cast("array<string>")).alias("none")).first()
    assert row["three"] == ["a", "b", "c", "a b", "b c"] and row["one"] == ["a"] and row["none"] == []


def test_terms_are_counted_in_as_many_tasks_as_a_shuffle_has(spark):
    """Texts of a merged partition would all be held as terms by one task."""
    from logsift.operators import features as D

    docs = spark.range(40).selectExpr("id AS doc_id", "concat('disk failed ', id) AS text")
    assert D.term_counts(docs, D.DEMO, ["doc_id"]).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
