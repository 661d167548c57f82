"""Reproducible samples. Order inside a class is the md5 of seed and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logsift.operators.ordering import attach, top_per_group

# rows of a class first compete inside this many salted groups
SALTS = 32


def draw_key(seed: int, id_column: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def sample_per_class(
    df: DataFrame, n: int, seed: int, id_column: str = "incident_id", label: str = "is_anomaly"
) -> DataFrame:
    """C4: at most ``n`` rows of each class, uniform and repeatable; ids must be unique.

    Classes compete on ids alone; the rows themselves are only filtered by the winners.
    """
    drawn = df.select(label, id_column).withColumn("_draw", draw_key(seed, id_column))
    order = [F.col("_draw"), F.col(id_column)]
    winners = top_per_group(drawn, [label], order, n, "_rank", SALTS).select(id_column)
    return attach(df, winners, id_column, "left_semi")


def _class_counts(df: DataFrame, label: str) -> dict[int, int]:
    return {row[0]: row[1] for row in df.groupBy(label).count().collect()}


def sample_exact(
    df: DataFrame, n: int, seed: int, id_column: str = "incident_id", label: str = "is_anomaly"
) -> DataFrame:
    """Exactly ``n`` rows of both classes, or an error."""
    counts = _class_counts(df, label)
    for value, name in ((0, "normal"), (1, "anomaly")):
        if counts.get(value, 0) < n:
            raise ValueError(f"Not enough {name} incidents to sample {n}.")
    return sample_per_class(df.filter(F.col(label).isin(0, 1)), n, seed, id_column, label)


def balanced_support(
    df: DataFrame,
    total: int,
    seed: int,
    id_column: str = "incident_id",
    label: str = "is_anomaly",
) -> DataFrame:
    """``total / 2`` rows per class. Chronology stays in the order-key columns."""
    if total <= 0:
        raise ValueError("total must be positive")
    if total % 2:
        raise ValueError("total must be even for a balanced sample")
    return sample_exact(df, total // 2, seed, id_column, label)
