"""Windows, samples and splits; results must not depend on partitioning."""

import pytest
from pyspark.sql import functions as F

from logsift.operators import ordering, sampling, splits, windows


def incidents(spark, n=10, parts=3):
    return spark.range(n).repartition(parts).select(
        F.col("id").alias("incident_id"), (F.col("id") % 2).cast("int").alias("is_anomaly"))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_dense_index_is_partition_invariant(spark, parts):
    df = spark.range(500).repartition(parts).select((F.col("id") * 7 % 500).alias("k"))
    rows = ordering.dense_index(df, F.col("k")).collect()
    assert all(r["k"] == r["pos"] for r in rows) and len(rows) == 500


def test_position_within_hot_key(spark):
    df = spark.range(300).select(F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 10))).alias("key"), "id")
    rows = ordering.position_within(df, ["key"], F.col("id")).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        assert r["pos"] == seen.get(r["key"], 0)
        seen[r["key"]] = r["pos"] + 1
    assert seen["hot"] == 200


def test_running_totals(spark):
    df = spark.range(100).repartition(5).select("id", F.lit(2).alias("v"))
    rows = ordering.running_totals(df, [F.desc("id")], {"v": "total"}).collect()
    assert all(r["total"] == 2 * (100 - r["id"]) for r in rows)


def test_count_windows_drop_the_rest(spark):
    lines = spark.range(47).repartition(4).select(
        "id", F.lit("t").alias("timestamp"), F.lit("s").alias("service"), F.lit("INFO").alias("severity"),
        F.col("id").cast("string").alias("message"), (F.col("id") == 25).cast("int").alias("is_alert"))
    rows = windows.count_windows(lines, F.col("id"), size=20).orderBy("window_number").collect()
    assert [r["incident_id"] for r in rows] == ["bgl-window-000000", "bgl-window-000001"]
    assert [r["is_anomaly"] for r in rows] == [0, 1]
    assert [e["message"] for e in rows[1]["events"]] == [str(i) for i in range(20, 40)]


def test_group_by_key_keeps_repeats(spark):
    lines = spark.createDataFrame([(0, "x blk_1 blk_1"), (1, "y blk_2"), (2, "z blk_1 blk_-3")], "n int, value string")
    selected = spark.createDataFrame([("blk_1",), ("blk_9",)], "block_id string")
    events = windows.group_by_key(windows.keyed_lines(lines), selected, F.col("n"), F.col("mention"))
    assert [(r["pos"], r["n"]) for r in events.orderBy("pos").collect()] == [(0, 0), (1, 0), (2, 2)]
    packed = windows.packed_incidents(events.select("block_id", "pos", "value"), "block_id", 2).orderBy("piece").collect()
    assert [len(r["events"]) for r in packed] == [2, 1]


def test_balanced_support(spark):
    df = incidents(spark, 6)
    first = sorted(r["incident_id"] for r in sampling.balanced_support(df, 4, 7).collect())
    again = sorted(r["incident_id"] for r in sampling.balanced_support(df.repartition(7), 4, 7).collect())
    assert first == again and len(first) == 4 and sum(i % 2 for i in first) == 2
    for wrong in (3, 0, 8):
        with pytest.raises(ValueError):
            sampling.balanced_support(df, wrong, 7)


def test_chronological_split_and_folds(spark):
    df = spark.range(1000).repartition(6).withColumnRenamed("id", "t")
    counts = {r["split"]: r["count"] for r in splits.chronological_split(df, ["t"]).groupBy("split").count().collect()}
    assert counts == {"train": 600, "validation": 200, "test": 200}
    folds = splits.expanding_folds(df, ["t"])
    got = {(r["fold"], r["role"]): (r["lo"], r["hi"]) for r in folds.groupBy("fold", "role").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    assert got["fold_1", "support"] == (0, 399) and got["fold_1", "evaluation"] == (600, 699)
    assert got["fold_3", "validation"] == (600, 799) and got["fold_3", "evaluation"] == (800, 999)
    with pytest.raises(ValueError):
        splits.expanding_folds(df.limit(99), ["t"])


def test_locked_holdout_is_later(spark):
    df = splits.locked_holdout(spark.range(50).withColumnRenamed("id", "window_number"))
    dev, locked = df.filter("period = 'development'"), df.filter("period = 'locked'")
    splits.assert_later(dev, locked, "window_number")
    assert dev.count() == 40
    with pytest.raises(RuntimeError):
        splits.assert_later(locked, dev, "window_number")


def test_ordered_split_needs_both_classes(spark):
    df = spark.range(20).select(F.col("id").alias("t"), (F.col("id") < 10).cast("int").alias("label"))
    with pytest.raises(ValueError):
        splits.ordered_split(df, ["t"], 0.8)
