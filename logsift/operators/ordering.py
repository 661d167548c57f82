"""Global positions, running totals and cuts without a single-task window.

A window without partitioning pulls the whole table into one task. The operators here
range-partition by the sort key, write the sorted rows once (``cut_lineage``), and add
per-partition offsets, of which there is one per partition. Order keys must be unique:
then equal leading values (a third of all rows on one timestamp, one key) still spread
over many partitions.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from logsift.session import cut_lineage

# Below this many rows a lookup side is broadcast; above it Spark shuffles (AQE splits
# skewed partitions). Rows of such sides are a few numbers and a key.
BROADCAST_ROWS = 500_000

# Up to this many counted values are put in order by one window.
WINDOW_ROWS = 50_000

_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row number below


def attach(
    df: DataFrame, lookup: DataFrame, on: str | list[str], how: str = "inner"
) -> DataFrame:
    """Join a lookup table, broadcasting it only after counting it."""
    small = lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(lookup) if small else lookup, on, how)


def attach_parts(df: DataFrame, lookup: DataFrame, on: list[str], frequency: str) -> list[DataFrame]:
    """Inner join with a lookup table that says how often each of its keys occurs in ``df``, as one part or two.

    Small lookups are broadcast. Of larger ones the most frequent keys, ``BROADCAST_ROWS`` at most, are
    broadcast and their rows stay where they are (first part); only rows of rare keys are shuffled (second part), so no
    task gets a hot key. A union would forget where the rows of the first part are.
    """
    if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return [df.join(F.broadcast(lookup), on)]
    # keys of every frequency, from the highest; the first that doesn't fit any more and all below are rare
    counted = lookup.groupBy(frequency).count().orderBy(F.desc(frequency)).limit(BROADCAST_ROWS + 1).collect()
    held, rare = 0, None
    for row in counted:
        held += row["count"]
        if held > BROADCAST_ROWS:
            rare = row[frequency]
            break
    hot = F.broadcast(lookup.filter(F.col(frequency) > rare))
    rest = df.join(hot.select(*on), on, "left_anti").join(lookup.filter(F.col(frequency) <= rare), on)
    return [df.join(hot, on), rest]


def attach_frequent(df: DataFrame, lookup: DataFrame, on: list[str], frequency: str) -> DataFrame:
    """``attach_parts`` as one table."""
    return functools.reduce(DataFrame.unionByName, attach_parts(df, lookup, on, frequency))


def _sorted_cut(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(placed).withColumn("_mid", F.monotonically_increasing_id())


def dense_index(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Positions 0..n-1 of the rows under ``order``, as a column."""
    cut = _sorted_cut(df, order).withColumn("_part", F.shiftright("_mid", _LOCAL_BITS))
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # one row per partition: bounded by the partition count
    offsets = sizes.select(
        "_part",
        (F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")).alias("_offset"),
    )
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        cut.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_mid", "_part", "_offset")
    )


def position_within(
    df: DataFrame, keys: list[str], *order: Column, name: str = "pos"
) -> DataFrame:
    """Positions 0..m-1 inside each key; a hot key is spread, never one task's window."""
    indexed = dense_index(df, *[F.col(k) for k in keys], *order, name="_global")
    starts = indexed.groupBy(*keys).agg(F.min("_global").alias("_start"))
    return (
        attach(indexed, starts, keys)
        .withColumn(name, F.col("_global") - F.col("_start"))
        .drop("_global", "_start")
    )


def running_totals(
    df: DataFrame, order: Sequence[Column], totals: dict[str, str]
) -> DataFrame:
    """Inclusive running sums under ``order``: ``totals`` maps a column to its new name."""
    cut = _sorted_cut(df, order).withColumn("_part", F.shiftright("_mid", _LOCAL_BITS))
    sums = cut.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in totals])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "_part", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                   for c in totals]
    )
    inside = W.partitionBy("_part").orderBy("_mid").rowsBetween(W.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(offsets), "_part")
    for column, name in totals.items():
        joined = joined.withColumn(name, F.sum(column).over(inside) + F.col(f"_o_{column}"))
    return joined.drop("_mid", "_part", *[f"_o_{c}" for c in totals])


def last_before(
    rows: DataFrame, marks: DataFrame, keys: Sequence[str], time: str, name: str = "mark"
) -> DataFrame:
    """As-of join: to each row the last mark of its key at or before its time, as a struct ``name``.

    ``marks``: keys, time and any columns; of equal times the mark that sorts last counts. Rows
    and marks are sorted together by key and time; the last mark of a partition is carried over
    the following ones, one row per partition, so a hot key stays spread. Rows without a mark (or with a null key or time) get null.
    """
    keys = list(keys)
    own = [c for c in rows.columns if c not in (*keys, time)]
    other = [c for c in marks.columns if c not in (*keys, time)]
    side = rows.select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_mark"), F.struct(*own).alias("_row"))
    stamp = marks.filter(F.col(time).isNotNull()).select(
        *keys, F.col(time).alias("_at"), F.lit(0).alias("_kind"), F.struct(time, *other).alias("_mark"), F.lit(None).alias("_row"))
    both = stamp.unionByName(side)
    order = [*[F.col(c) for c in keys], F.col("_at"), F.col("_kind"), F.col("_mark"), F.xxhash64("_row")]
    cut = _sorted_cut(both, order).withColumn("_part", F.shiftright("_mid", _LOCAL_BITS)).withColumn(
        "_seen", F.when(F.col("_mark").isNotNull(), F.struct(*keys, "_mark")))
    ends = cut.groupBy("_part").agg(F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("_mid"))).alias("_end"))
    # one row per partition
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(
        W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    inside = W.partitionBy("_part").orderBy("_mid").rowsBetween(W.unboundedPreceding, 0)
    found = cut.withColumn("_here", F.last("_seen", ignorenulls=True).over(inside)).filter("_kind = 1").join(F.broadcast(carried), "_part")
    found = found.withColumn("_last", F.coalesce("_here", "_carried"))
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(f"_last.{c}") == F.col(c))
    return found.select(
        *keys, F.col("_at").alias(time), "_row.*", F.when(same & F.col("_at").isNotNull(), F.col("_last._mark")).alias(name))


def exact_quantiles(
    df: DataFrame, value: str, quantiles: Sequence[float], by: Sequence[str] = (),
) -> DataFrame:
    """Linear-interpolated quantiles per group as the array ``quantiles``; nulls don't count.

    Equal values are counted first; positions come from running totals over the sorted
    distinct values, so no task ever holds them all. Without any value there is no row.
    """
    present = df.filter(F.col(value).isNotNull())
    keys = list(by)
    if not keys:
        present, keys = present.withColumn("_all", F.lit(0)), ["_all"]
    counted = cut_lineage(present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    if counted.limit(WINDOW_ROWS + 1).count() <= WINDOW_ROWS:  # few values: a window holds them
        group = W.partitionBy(*keys)
        placed = counted.withColumn("_total", F.sum("_n").over(group)).withColumn(
            "_at", F.sum("_n").over(group.orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    else:
        upto = running_totals(counted, [F.col(c) for c in (*keys, value)], {"_n": "_upto"})
        upto = upto.select(*keys, value, "_n", "_upto")
        groups = upto.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.max("_upto").alias("_end"))
        placed = attach(upto, groups, keys).withColumn("_at", F.col("_upto") - (F.col("_end") - F.col("_total")))

    def position(q: float) -> Column:
        return F.lit(float(q)) * (F.col("_total") - 1)

    found = placed.groupBy(*keys, "_total").agg(*[
        F.min(F.when(F.col("_at") > edge(position(q)), F.col(value))).alias(f"_{side}{i}")
        for i, q in enumerate(quantiles) for side, edge in (("low", F.floor), ("high", F.ceil))])
    return found.select(*by, F.array(*[
        F.col(f"_low{i}") + (position(q) - F.floor(position(q))) * (F.col(f"_high{i}") - F.col(f"_low{i}"))
        for i, q in enumerate(quantiles)]).alias("quantiles"))


def rows_at(df: DataFrame, positions: Sequence[int], *order: str) -> dict[int, Row]:
    """The order keys found at the given positions. Only key columns are sorted."""
    keys = dense_index(df.select(*order), *[F.col(c) for c in order])
    found = keys.filter(F.col("pos").isin([int(p) for p in positions])).collect()
    return {row["pos"]: row for row in found}


def before_row(row: Row, *order: str) -> Column:
    """True for rows that sort strictly before ``row``; a filter, so it can push down."""
    result = F.lit(False)
    equal = F.lit(True)
    for column in order:
        result = result | (equal & (F.col(column) < F.lit(row[column])))
        equal = equal & (F.col(column) == F.lit(row[column]))
    return result


def top_per_group(
    df: DataFrame, keys: list[str], order: Sequence[Column], k: int, name: str = "rank",
    salts: int = 1,
) -> DataFrame:
    """First ``k`` rows of each key, ranked from 1.

    Spark prunes each map partition to k rows per key before the shuffle. With
    ``salts`` > 1 a pre-round over salted keys keeps the last task of a key at
    ``k * salts`` rows however many partitions fed it.
    """
    if salts > 1:
        salted = df.withColumn(
            "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _plain(df, c)]), salts)
        )
        first = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_rank", F.row_number().over(first))
            .filter(F.col("_rank") <= k)
            .drop("_salt", "_rank")
        )
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def _plain(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() not in ("map", "variant")
