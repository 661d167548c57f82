"""Incidents from log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logsift import constants as C
from logsift.functions import text as X
from logsift.operators.ordering import attach, dense_index, position_within


def alert_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """B1 as a table operator; blank lines are dropped."""
    fields = X.parse_alert_line(F.col(value))
    return lines.filter(X.strip(F.col(value)) != "").select(
        *[c for c in lines.columns if c != value],
        *[expr.alias(name) for name, expr in fields.items()],
    )


def numbered_events(
    events: DataFrame, *order: Column, size: int = C.WINDOW_SIZE, number: str | None = None
) -> DataFrame:
    """C1, normalised form: each event with its window number and place in the window.

    ``number`` names a column with the events' places (``numbered_log_lines``); without it
    they are found by sorting keys.
    """
    indexed = dense_index(events, *order, name="_line") if number is None else events.withColumnRenamed(number, "_line")
    return (
        indexed.withColumn("window_number", F.floor(F.col("_line") / size).cast("bigint"))
        .withColumn("place", (F.col("_line") % size).cast("int"))
        .drop("_line")
    )


def count_windows(
    events: DataFrame, *order: Column, size: int = C.WINDOW_SIZE, number: str | None = None
) -> DataFrame:
    """Incidents of ``size`` consecutive events; the incomplete last one is dropped.

    A group holds ``size`` events at most, so packing them into an array is bounded.
    Order and ``number`` as in ``numbered_events``.
    """
    event = F.struct("timestamp", "service", "severity", "message")
    return (
        numbered_events(events, *order, size=size, number=number)
        .groupBy("window_number")
        .agg(
            F.count(F.lit(1)).alias("_events"),
            F.max("is_alert").cast("int").alias("is_anomaly"),
            F.sort_array(F.collect_list(F.struct("place", event.alias("event")))).alias("_packed"),
        )
        .filter(F.col("_events") == size)
        .select(
            X.window_id(F.col("window_number")).alias("incident_id"),
            "window_number",
            "is_anomaly",
            F.lit("unknown").alias("root_cause"),
            F.transform("_packed", lambda p: p["event"]).alias("events"),
        )
    )


def sliding_count_windows(
    lines: DataFrame,
    key: str,
    *order: Column,
    size: int = C.SLIDING_SIZE,
    stride: int = C.SLIDING_STRIDE,
) -> DataFrame:
    """Overlapping windows of each key, complete windows only.

    Returns one row per (key, window, place). A line belongs to ``size / stride``
    windows; positions inside a key come from offsets, so a hot key stays spread.
    """
    placed = position_within(lines, [key], *order, name="_pos")
    sizes = placed.groupBy(key).agg((F.max("_pos") + 1).alias("_lines"))
    last_start = F.floor(F.col("_pos") / stride)
    first_start = F.greatest(
        F.lit(0), F.floor((F.col("_pos") - size) / stride) + 1
    )
    return (
        attach(placed, sizes, key)
        .withColumn("window_number", F.explode(F.sequence(first_start, last_start)))
        .filter(F.col("window_number") * stride + size <= F.col("_lines"))
        .withColumn("place", (F.col("_pos") - F.col("window_number") * stride).cast("int"))
        .drop("_pos", "_lines")
    )


def keyed_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """B2: one row per block id named in a line; a line naming it twice counts twice."""
    found = F.posexplode(X.block_keys(F.col(value))).alias("mention", "block_id")
    return lines.select("*", found)


def label_lines(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of each keyed line, ``Unknown`` where none is known."""
    return (
        attach(keyed, labels.select("block_id", F.col("label").alias("_label")), "block_id", "left")
        .withColumn("label", F.coalesce("_label", F.lit("Unknown")))
        .drop("_label")
    )


def group_by_key(
    keyed: DataFrame, selected: DataFrame, *order: Column, key: str = "block_id"
) -> DataFrame:
    """C3, normalised form: events of the selected keys with their position.

    Keys without lines do not appear. Nothing is collected, so one key may hold any
    number of lines; ``packed_incidents`` makes the nested form in bounded pieces.
    """
    kept = attach(keyed, selected, key)
    return position_within(kept, [key], *order)


def packed_incidents(
    events: DataFrame, key: str, size: int = 500, position: str = "pos"
) -> DataFrame:
    """Nested form of C3: events arrays of at most ``size``, numbered by ``piece``."""
    fields = [c for c in events.columns if c not in (key, position)]
    return (
        events.withColumn("piece", F.floor(F.col(position) / size).cast("bigint"))
        .groupBy(key, "piece")
        .agg(F.sort_array(F.collect_list(
            F.struct(position, F.struct(*fields).alias("event")))).alias("_packed"))
        .select(key, "piece", F.transform("_packed", lambda p: p["event"]).alias("events"))
    )
