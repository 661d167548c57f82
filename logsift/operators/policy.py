"""Thresholds, calibrated policies and decisions.

Every grid search is one pass over the scores: a row falls into a cell of the grid,
cells are counted with map-side combining, and the few hundred cells are accumulated.
No grid cell multiplies the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from logsift import constants as C
from logsift.functions import risk
from logsift.operators.ordering import exact_quantiles


def grid_cell(value: Column, grid: Sequence[float]) -> Column:
    """How many grid points lie at or below the value (grid ascending)."""
    return sum(((value >= F.lit(float(g))).cast("int") for g in grid), F.lit(0))


def _f1(tp: Column, predicted: Column, positives: Column) -> Column:
    total = predicted + positives
    return F.when(total > 0, 2.0 * tp / total).otherwise(0.0)


def threshold_sweep(
    scores: DataFrame, grid: Sequence[float], label: str = "label", score: str = "score"
) -> DataFrame:
    """G1: precision, recall and F1 at each threshold."""
    grid = sorted({float(g) for g in grid})
    cells = scores.select(
        grid_cell(F.col(score), grid).alias("cell"), F.col(label).cast("int").alias("y")
    ).groupBy("cell").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    # one row: cumulative sums over at most len(grid) + 1 cells
    packed = cells.agg(F.collect_list(F.struct("cell", "pos", "n")).alias("cells"))
    points = F.array(*[
        F.struct(F.lit(i + 1).alias("cell"), F.lit(g).alias("threshold"))
        for i, g in enumerate(grid)
    ])

    def total(name: str, at: Column) -> Column:
        return F.aggregate(
            "cells", F.lit(0).cast("bigint"),
            lambda acc, c: acc + F.when(c["cell"] >= at, c[name]).otherwise(0),
        )

    swept = packed.select("cells", F.inline(points)).select(
        "threshold",
        total("pos", F.col("cell")).alias("tp"),
        total("n", F.col("cell")).alias("predicted"),
        total("pos", F.lit(0)).alias("positives"),
    )
    return swept.select(
        "threshold",
        F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0).alias("precision"),
        F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0).alias("recall"),
        _f1(F.col("tp"), F.col("predicted"), F.col("positives")).alias("f1"),
    )


def best_f1_threshold(
    scores: DataFrame, grid: Sequence[float], label: str = "label", score: str = "score"
) -> DataFrame:
    """The first threshold with the highest F1, as one row."""
    return threshold_sweep(scores, grid, label, score).orderBy(
        F.desc("f1"), F.asc("threshold")
    ).limit(1)


def score_quantiles(scores: DataFrame, quantiles: Sequence[float], score: str = "score") -> list[float]:
    """Exact linear-interpolated quantiles: a handful of numbers for the driver."""
    found = exact_quantiles(scores, score, quantiles).first()
    if found is None:
        raise ValueError("Quantiles need at least one score.")
    return [float(v) for v in found["quantiles"]]


def select_blend(
    scores: DataFrame,
    weights: Sequence[float] = C.BLEND_WEIGHTS,
    thresholds: Sequence[float] = C.F1_GRID,
    label: str = "label",
) -> DataFrame:
    """Source weight and threshold of the highest F1; ties prefer less source.

    Among equal F1 and weight the earlier threshold wins. ``scores`` holds ``source_p``
    and ``target_p``.
    """
    if not weights or not thresholds:
        raise ValueError("source_weights and thresholds must not be empty")
    grid = sorted({float(t) for t in thresholds})
    points = [float(w) for w in weights]
    blended = F.array(*[
        grid_cell(risk.blend(F.col("source_p"), F.col("target_p"), w), grid) for w in points
    ])
    # one row in, one row out: the array of cells is the group key
    combos = (
        scores.select(blended.alias("cells"), F.col(label).cast("int").alias("y"))
        .groupBy("cells")
        .agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    cells = (
        combos.select("pos", "n", F.posexplode("cells").alias("w", "cell"))
        .groupBy("w", "cell")
        .agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    )
    packed = cells.groupBy("w").agg(F.collect_list(F.struct("cell", "pos", "n")).alias("cells"))
    thresholds_table = F.array(*[
        F.struct(F.lit(i + 1).alias("cell"), F.lit(g).alias("anomaly_threshold"))
        for i, g in enumerate(grid)
    ])

    def total(name: str, at: Column) -> Column:
        return F.aggregate(
            "cells", F.lit(0).cast("bigint"),
            lambda acc, c: acc + F.when(c["cell"] >= at, c[name]).otherwise(0),
        )

    return (
        packed.select("w", "cells", F.inline(thresholds_table))
        .select(
            F.element_at(F.array(*[F.lit(w) for w in points]), F.col("w") + 1).alias("source_weight"),
            "anomaly_threshold",
            _f1(total("pos", F.col("cell")), total("n", F.col("cell")), total("pos", F.lit(0)))
            .alias("validation_f1"),
        )
        .orderBy(F.desc("validation_f1"), F.asc("source_weight"), F.asc("anomaly_threshold"))
        .limit(1)
    )


def ood_threshold(scores: DataFrame, rate: float = C.OOD_RATE, score: str = "top_similarity") -> float:
    """The similarity below which the given share of incidents lies."""
    if not 0.0 < rate < 1.0:
        raise ValueError("allowed_source_ood_rate must be between 0 and 1.")
    return score_quantiles(scores, [rate], score)[0]


def in_distribution(similarity: Column, cutoff: float) -> Column:
    """G5."""
    return similarity >= cutoff


@dataclass(frozen=True)
class Policy:
    """A fitted abstention policy; ``None`` fields belong to other calibrations."""

    confidence_threshold: float
    similarity_threshold: float
    coverage: float
    automated_accuracy: float
    unsafe_rate: float
    errors: int
    automated: int
    unsafe_upper_bound: float | None = None
    per_policy_confidence: float | None = None

    def as_row(self) -> Row:
        return Row(**asdict(self))


def assessed(scores: DataFrame, threshold: float | Column, label: str = "label") -> DataFrame:
    """Columns every abstention rule uses, from p, top_similarity, evidence_label, unanimous."""
    return (
        scores.withColumn("prediction", risk.predicted_label(F.col("p"), threshold))
        .withColumn("confidence", risk.threshold_confidence(F.col("p"), threshold))
        .withColumn("agrees", F.col("evidence_label") == F.col("prediction"))
        .withColumn("wrong", (F.col("prediction") != F.col(label)).cast("int"))
    )


def grid_cells(
    rows: DataFrame, confidence: Column, similarity: Column, by: Sequence[str] = ()
) -> dict[tuple, tuple[int, dict[tuple[int, int], tuple[int, int]]]]:
    """Per group: total rows, and per (confidence cell, similarity cell) the eligible and wrong rows."""
    eligible = (F.col("unanimous") & F.col("agrees")).cast("int")
    counted = (
        rows.select(*by, confidence.alias("c"), similarity.alias("s"), eligible.alias("e"), (eligible * F.col("wrong")).alias("w"))
        .groupBy(*by, "c", "s")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"), F.sum("w").alias("w"))
        .collect()
    )
    found: dict[tuple, tuple[int, dict]] = {}
    for r in counted:
        key = tuple(r[c] for c in by)
        total, cells = found.get(key, (0, {}))
        found[key] = (total + r["n"], cells | {(r["c"], r["s"]): (r["e"], r["w"])})
    return found


def calibrate_abstention(
    scores: DataFrame,
    threshold: float,
    *,
    similarity: Sequence[float] = C.SIMILARITY_GRID,
    confidence: Sequence[float] = C.CONFIDENCE_GRID,
    maximum_unsafe: float = C.MAX_UNSAFE_RATE,
    minimum_automated: int = 1,
    familywise: float | None = None,
    label: str = "label",
) -> Policy:
    """Highest coverage whose unsafe rate, or its upper bound, stays in limits.

    ``similarity`` is a set: repeats count once. With ``familywise`` the Wilson bound of
    each candidate is taken at a Bonferroni-adjusted confidence. The first candidate
    (confidence outer, similarity inner, ascending) wins a tie.
    """
    similarity = sorted({float(s) for s in similarity})
    confidence = sorted({float(c) for c in confidence})
    counted = grid_cells(
        assessed(scores, threshold, label), grid_cell(F.col("confidence"), confidence), grid_cell(F.col("top_similarity"), similarity))
    return best_policy(
        *counted.get((), (0, {})), confidence, similarity, maximum_unsafe=maximum_unsafe,
        minimum_automated=minimum_automated, familywise=familywise)


def best_policy(
    total: int,
    cells: dict[tuple[int, int], tuple[int, int]],
    confidence: Sequence[float],
    similarity: Sequence[float],
    *,
    maximum_unsafe: float = C.MAX_UNSAFE_RATE,
    minimum_automated: int = 1,
    familywise: float | None = None,
) -> Policy:
    """The policy of ``calibrate_abstention`` from counted cells of ascending grids."""
    per_policy = (
        None if familywise is None
        else 1.0 - (1.0 - familywise) / (len(confidence) * len(similarity))
    )
    best: Policy | None = None
    for c, c_value in enumerate(confidence, 1):
        for s, s_value in enumerate(similarity, 1):
            hits = [v for (i, j), v in cells.items() if i >= c and j >= s]
            automated, errors = sum(h[0] for h in hits), sum(h[1] for h in hits)
            if automated < max(1, minimum_automated):
                continue
            # the unsafe rate is one minus the accuracy, as in the published reports
            unsafe = errors / automated if familywise is not None else 1.0 - (
                (automated - errors) / automated)
            bound = None if per_policy is None else wilson_bound(errors, automated, per_policy)
            if (unsafe if bound is None else bound) > maximum_unsafe:
                continue
            if best is None or automated / total > best.coverage:
                best = Policy(c_value, s_value, automated / total, 1.0 - unsafe, unsafe,
                              errors, automated, bound, per_policy)
    if best is None:
        raise RuntimeError("No validation policy met the safety target.")
    return best


def wilson_bound(errors: int, total: int, confidence: float) -> float:
    """G7 for one candidate on the driver, where grid cells already are plain numbers."""
    if total <= 0:
        return 1.0
    z = risk.normal_quantile(confidence)
    rate, square = errors / total, z * z
    spread = ((rate * (1.0 - rate) + square / (4.0 * total)) / total) ** 0.5
    return min(1.0, (rate + square / (2.0 * total) + z * spread) / (1.0 + square / total))


def quantile_grid(scores: DataFrame, cutoff: float, score: str = "top_similarity") -> list[float]:
    """The similarity candidates, a set."""
    return sorted({cutoff, *score_quantiles(scores, C.SIMILARITY_QUANTILES, score)})


def similarity_candidates(scores: DataFrame, score: str = "top_similarity") -> tuple[float, list[float]]:
    """G4 and G12 in one pass: the out-of-distribution cutoff and the similarity candidates."""
    cutoff, *rest = score_quantiles(scores, [C.OOD_RATE, *C.SIMILARITY_QUANTILES], score)
    return cutoff, sorted({cutoff, *rest})


def calibrate_safety_policy(
    scores: DataFrame, threshold: float, cutoff: float | None = None, label: str = "label"
) -> Policy:
    """G13. Without a cutoff it is the one of ``ood_threshold``, found with the other candidates."""
    grid = similarity_candidates(scores)[1] if cutoff is None else quantile_grid(scores, cutoff)
    return calibrate_abstention(
        scores, threshold, similarity=grid,
        minimum_automated=C.MIN_AUTOMATED, familywise=C.FAMILYWISE_CONFIDENCE, label=label,
    )


def _packed_cells(
    votes: DataFrame, keys: Sequence[str], grid: Sequence[float], measures: dict[str, Column]
) -> DataFrame:
    """Per key one row: measures summed from each grid threshold upwards."""
    grid = list(grid)
    cells = (
        votes.select(*keys, grid_cell(F.col("top_similarity"), grid).alias("cell"),
                     *[m.cast("int").alias(n) for n, m in measures.items()])
        .groupBy(*keys, "cell")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(n) for n in measures])
        .groupBy(*keys)
        .agg(F.sum("_n").alias("total"),
             F.collect_list(F.struct("cell", *measures)).alias("cells"))
    )
    points = F.array(*[
        F.struct(F.lit(i + 1).alias("at"), F.lit(float(g)).alias("threshold"))
        for i, g in enumerate(grid)
    ])
    opened = cells.select(*keys, "total", "cells", F.inline(points))

    def from_threshold(name: str) -> Column:
        return F.aggregate(
            "cells", F.lit(0).cast("bigint"),
            lambda acc, c: acc + F.when(c["cell"] >= F.col("at"), c[name]).otherwise(0),
        ).alias(name)

    return opened.select(*keys, "total", "threshold", *[from_threshold(n) for n in measures])


def calibrate_retrieval_hybrid(
    votes: DataFrame,
    thresholds: Sequence[float] = C.HYBRID_THRESHOLDS,
    maximum_unsafe: float = C.MAX_UNSAFE_RATE,
) -> DataFrame:
    """Per semantic weight the admissible threshold with most coverage.

    ``votes``: semantic_weight, top_similarity, evidence_label, unanimous, label, hits3
    (matches with the query's label). A threshold automating nothing is admissible with
    unsafe rate 0; the lowest threshold wins a tie.
    """
    correct = (F.col("evidence_label") == F.col("label"))
    ranking = votes.groupBy("semantic_weight").agg(
        F.avg(correct.cast("int")).alias("precision_at_1"),
        (F.sum("hits3") / F.sum("matches")).alias("precision_at_3"),
    )
    swept = _packed_cells(votes, ["semantic_weight"], thresholds, {
        "automated": F.col("unanimous"), "right": F.col("unanimous") & correct,
    })
    rated = swept.select(
        "semantic_weight", "threshold",
        (F.col("automated") / F.col("total")).alias("coverage"),
        F.when(F.col("automated") > 0, F.col("right") / F.col("automated")).otherwise(0.0)
        .alias("accuracy"),
        F.when(F.col("automated") > 0, 1.0 - F.col("right") / F.col("automated")).otherwise(0.0)
        .alias("unsafe_rate"),
    ).filter(F.col("unsafe_rate") <= maximum_unsafe)
    best = rated.groupBy("semantic_weight").agg(
        F.max_by(F.struct("threshold", "coverage", "accuracy", "unsafe_rate"),
                 F.struct("coverage", -F.col("threshold"))).alias("b")
    ).select("semantic_weight", "b.*")
    return ranking.join(best, "semantic_weight", "left")


def calibrate_retrieval_votes(
    votes: DataFrame, thresholds: Sequence[float] = C.VOTE_THRESHOLDS
) -> DataFrame:
    """Coverage, accuracy and unsafe rate per threshold, by majority and unanimously."""
    majority = (F.col("anomaly_votes") > F.col("matches") / 2).cast("int")
    right = majority == F.col("label")
    swept = _packed_cells(votes, [], thresholds, {
        "a_majority": F.lit(1), "r_majority": right,
        "a_unanimous": F.col("unanimous"), "r_unanimous": F.col("unanimous") & right,
    })
    rows = swept.select("total", "threshold", F.inline(F.array(*[
        F.struct(F.lit(m).alias("policy"), F.col(f"a_{m}").alias("a"), F.col(f"r_{m}").alias("r"))
        for m in ("majority", "unanimous")
    ])))
    some = F.col("a") > 0
    return rows.select(
        "threshold", "policy", (F.col("a") / F.col("total")).alias("coverage"),
        F.when(some, F.col("r") / F.col("a")).otherwise(0.0).alias("accuracy"),
        F.when(some, (F.col("a") - F.col("r")) / F.col("a")).otherwise(0.0).alias("unsafe_rate"),
    )


def triage_decision(
    scores: DataFrame, threshold: float, policy: Policy, label: str | None = None
) -> DataFrame:
    """Recommendation plus each check, from p and the evidence aggregate of a row."""
    rows = assessed(scores if label else scores.withColumn("_label", F.lit(0)),
                    threshold, label or "_label").drop("_label", *([] if label else ["wrong"]))
    checked = rows.withColumn(
        "confidence_passed", F.col("confidence") >= policy.confidence_threshold
    ).withColumn("similarity_passed", F.col("top_similarity") >= policy.similarity_threshold)
    automated = (
        F.col("confidence_passed") & F.col("similarity_passed")
        & F.col("unanimous") & F.col("agrees")
    )
    return checked.withColumn("automated", automated).withColumn(
        "recommendation",
        F.when(~F.col("automated"), C.NEEDS_REVIEW)
        .when(F.col("prediction") == 1, C.LIKELY_ANOMALY)
        .otherwise(C.LIKELY_NORMAL),
    )


def guarded(decisions: DataFrame, cutoff: float) -> DataFrame:
    """Automation also needs a similarity inside the source distribution."""
    return decisions.withColumn(
        "automated", F.col("automated") & in_distribution(F.col("top_similarity"), cutoff)
    )


def analyze_decision(rows: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Rows hold anomaly_p, cause, cause_p and evidence_count."""
    supported = (
        (F.least("anomaly_p", "cause_p") >= threshold) & (F.col("evidence_count") > 0)
    )
    return rows.withColumn(
        "decision", F.when(supported, C.ANALYZED).otherwise(C.NEEDS_REVIEW)
    ).withColumn("root_cause", F.when(supported, F.col("cause")))


def find_review_case(decisions: DataFrame, *order: Column) -> DataFrame:
    """The earliest decision that went to review."""
    return decisions.filter(F.col("recommendation") == C.NEEDS_REVIEW).orderBy(*order).limit(1)
