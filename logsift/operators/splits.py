"""Splits. Cuts are found on key columns and applied as filters on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logsift import constants as C
from logsift.operators.ordering import before_row, dense_index, rows_at
from logsift.operators.sampling import draw_key


def chronological_split(
    df: DataFrame, order: list[str], fractions: tuple[float, ...] = (0.60, 0.80),
    names: tuple[str, ...] = ("train", "validation", "test"),
) -> DataFrame:
    """Adds ``split`` by position under unique ``order`` columns."""
    total = df.count()
    cuts = [int(total * f) for f in fractions]
    if not total:
        return df.withColumn("split", F.lit(None).cast("string"))
    role = F.lit(names[-1])
    found = rows_at(df, [c for c in cuts if c < total], *order)
    for cut, name in reversed(list(zip(cuts, names))):
        inside = before_row(found[cut], *order) if cut < total else F.lit(True)
        role = F.when(inside, name).otherwise(role)
    return df.withColumn("split", role)


def ordered_split(
    df: DataFrame, order: list[str], fraction: float, label: str = "label"
) -> DataFrame:
    """C11: train before the cut, test after; both must hold both classes."""
    split = chronological_split(df, order, (fraction,), ("train", "test"))
    counts = {(r["split"], r[label]): r["count"] for r in split.groupBy("split", label).count().collect()}
    if any(not counts.get((part, value)) for part in ("train", "test") for value in (0, 1)):
        raise ValueError("Chronological split must contain both classes in train and test.")
    return split


def locked_holdout(
    windows: DataFrame, fraction: float = 0.80, number: str = "window_number"
) -> DataFrame:
    """Adds ``period`` (development or locked) by window number, before any sampling."""
    last = windows.agg(F.max(number)).first()[0]
    total = 0 if last is None else last + 1
    limit = int(total * fraction)
    return windows.withColumn(
        "period", F.when(F.col(number) < limit, "development").otherwise("locked")
    )


def assert_later(development: DataFrame, locked: DataFrame, number: str) -> None:
    """C8 guard: every locked window starts after the last development window."""
    last = development.agg(F.max(number)).first()[0]
    first = locked.agg(F.min(number)).first()[0]
    if last is not None and first is not None and last >= first:
        raise RuntimeError("Locked holdout is not temporally later than development data.")


def expanding_folds(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per (fold, row in the fold) with its ``role``.

    Three folds, so a row is repeated at most three times; no join.
    """
    total = df.count()
    if total < 100:
        raise ValueError("Need at least 100 incidents for temporal backtesting")
    bounds = {
        name: [int(total * f) for f in fractions]
        for name, *fractions in C.BACKTEST_FOLDS
    }
    wanted = {cut for cuts in bounds.values() for cut in cuts if cut < total}
    found = rows_at(df, sorted(wanted), *order)

    def inside(cut: int) -> Column:
        return before_row(found[cut], *order) if cut < total else F.lit(True)

    tags = [
        F.struct(
            F.lit(name).alias("fold"),
            F.when(inside(support), "support")
            .when(inside(validation), "validation")
            .when(inside(evaluation), "evaluation")
            .alias("role"),
        )
        for name, (support, validation, evaluation) in bounds.items()
    ]
    return (
        df.select("*", F.inline(F.array(*tags)))
        .filter(F.col("role").isNotNull())
    )


def stratified_split(
    df: DataFrame,
    fractions: tuple[float, ...],
    names: tuple[str, ...],
    seed: int,
    id_column: str = "incident_id",
    label: str = "is_anomaly",
) -> DataFrame:
    """Per class, the first ``floor(n * f)`` rows under the seeded draw, and so on."""
    drawn = df.withColumn("_draw", draw_key(seed, id_column))
    order = ["_draw", id_column]
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    keys = dense_index(drawn.select(label, *order), F.col(label), *[F.col(c) for c in order])
    start, wanted = 0, {}
    for value in sorted(sizes):
        for position, fraction in enumerate(fractions):
            cut = int(sizes[value] * fraction)
            if cut < sizes[value]:
                wanted[start + cut] = (value, position)
        start += sizes[value]
    found = {
        wanted[r["pos"]]: r
        for r in keys.filter(F.col("pos").isin(list(wanted))).collect()
    }
    role = None
    for value in sorted(sizes):
        part = F.lit(names[-1])
        for position in reversed(range(len(fractions))):
            row = found.get((value, position))
            inside = before_row(row, *order) if row else F.lit(True)
            part = F.when(inside, names[position]).otherwise(part)
        role = F.when(F.col(label) == value, part) if role is None else role.when(
            F.col(label) == value, part)
    return drawn.withColumn("split", role).drop("_draw")


def class_counts(df: DataFrame, *by: str) -> DataFrame:
    """C12."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
