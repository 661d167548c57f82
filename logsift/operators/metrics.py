"""Evaluation as conditional sums; rows never leave the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logsift import constants as C
from logsift.operators.ordering import attach, exact_quantiles, running_totals


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def classification_metrics(
    scores: DataFrame, threshold: float, by: Sequence[str] = (), label: str = "label",
    score: str = "score",
) -> DataFrame:
    """H1: accuracy, precision, recall and F1; zero where undefined."""
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    sums = scores.groupBy(*by).agg(
        count_if(y & hit).alias("tp"), count_if(~y & hit).alias("fp"),
        count_if(y & ~hit).alias("fn"), F.count(F.lit(1)).alias("n"),
    )
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    return sums.select(
        *by,
        ratio(n - fp - fn, n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def average_precision(
    scores: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """H2: sum of recall gains times precision over distinct scores, highest first."""
    by = list(by)
    points = scores.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    totals = running_totals(points, [*[F.col(c) for c in by], F.desc(score)], {"pos": "tp", "n": "predicted"})
    if by:  # less what the groups before have
        before = totals.groupBy(*by).agg(
            F.min(F.col("tp") - F.col("pos")).alias("_tp"), F.min(F.col("predicted") - F.col("n")).alias("_predicted"))
        totals = attach(totals, before, by).withColumns(
            {"tp": F.col("tp") - F.col("_tp"), "predicted": F.col("predicted") - F.col("_predicted")})
    return totals.groupBy(*by).agg(
        F.when(
            F.sum("pos") > 0,
            F.sum(F.col("pos") * F.col("tp") / F.col("predicted")) / F.sum("pos"),
        ).otherwise(0.0).alias("average_precision")
    )


def class_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """H3: precision, recall, F1 and support per class, with macro and weighted averages."""
    pairs = predictions.groupBy(F.col(label).alias("y"), F.col(prediction).alias("yhat")).count()
    # each confusion cell counts once for its true class and once for its predicted class
    zero = F.lit(0).cast("bigint")

    def side(label: str, support: Column, predicted: Column, tp: Column) -> Column:
        return F.struct(F.col(label).alias("class"), support.alias("support"),
                        predicted.alias("predicted"), tp.alias("tp"))

    right = F.when(F.col("y") == F.col("yhat"), F.col("count")).otherwise(0)
    sides = pairs.select(F.inline(F.array(
        side("y", F.col("count"), zero, right), side("yhat", zero, F.col("count"), zero))))
    per = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    ).select(
        F.col("class").cast("string").alias("class"),
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )
    names = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names],
                    F.sum("support").alias("support"))
    weighted = per.agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def selective_metrics(
    decisions: DataFrame, by: Sequence[str] = (), empty: float | None = None,
    median: bool = False,
) -> DataFrame:
    """H4, H6: coverage and safety of the automated part.

    ``empty`` is the accuracy and unsafe rate when nothing is automated: 0.0 or None.
    ``median`` adds the median similarity (H6).
    """
    auto = F.col("automated")
    sums = decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_incidents"),
        count_if(auto).alias("automated_incidents"),
        count_if(auto & (F.col("wrong") == 1)).alias("unsafe_decisions"),
        F.avg("top_similarity").alias("mean_maximum_similarity"),
        count_if(F.col("top_similarity") == 0).alias("zero"),
    )
    if median:
        middle = exact_quantiles(decisions, "top_similarity", [0.5], by).select(
            *by, F.element_at("quantiles", 1).alias("median_maximum_similarity"))
        if by:
            sums = attach(sums, middle, list(by), "left")
        else:
            row = middle.first()  # one number
            sums = sums.withColumn("median_maximum_similarity", F.lit(row and row[0]).cast("double"))
    n, done, bad = (F.col(c) for c in ("total_incidents", "automated_incidents", "unsafe_decisions"))
    return sums.select(
        *by, n, done, (n - done).alias("abstained_incidents"),
        ratio(done, n).alias("coverage"),
        ratio(done - bad, done, empty).alias("automated_accuracy"),
        ratio(bad, done, empty).alias("unsafe_decision_rate"),
        bad, "mean_maximum_similarity", ratio(F.col("zero"), n).alias("zero_similarity_rate"),
        *(["median_maximum_similarity"] if median else []),
    )


def ranking_metrics(matches: DataFrame, by: Sequence[str] = (), truth: str = "true_label") -> DataFrame:
    """H5: share of matches with the query's label, at rank 1 and over all ranks."""
    same = F.col("label") == F.col(truth)
    return matches.groupBy(*by).agg(
        (count_if((F.col("rank") == 1) & same) / count_if(F.col("rank") == 1)).alias("precision_at_1"),
        (count_if(same) / F.count(F.lit(1))).alias("precision_at_3"),
    )


def retrieval_policy_metrics(votes: DataFrame, minimum_score: float, by: Sequence[str] = ()) -> DataFrame:
    """A fixed similarity-and-unanimity policy on a final split."""
    auto = (F.col("top_similarity") >= minimum_score) & F.col("unanimous")
    wrong = (F.col("evidence_label") != F.col("label")).cast("int")
    decided = votes.withColumn("automated", auto).withColumn("wrong", wrong)
    return selective_metrics(decided, by, empty=0.0).select(
        *by, "coverage", "automated_accuracy", "unsafe_decision_rate", "unsafe_decisions")


def seed_summary(results: DataFrame, seeds: Sequence[int] = C.STUDY_SEEDS) -> DataFrame:
    """H7: mean and sample deviation per support size, method and metric, one column per seed."""
    keys = ["support_size", "method", "metric"]
    return results.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sample_std"),
        *[F.max(F.when(F.col("seed") == s, F.col("value"))).alias(f"seed_{s}") for s in seeds],
    )


def paired_effects(results: DataFrame, treated: str, baseline: str) -> DataFrame:
    """H8: mean and deviation over seeds of the paired metric differences."""
    keys = ["support_size", "metric", "seed"]
    paired = results.filter(F.col("method").isin(treated, baseline)).groupBy(*keys).agg(
        F.max(F.when(F.col("method") == treated, F.col("value"))).alias("t"),
        F.max(F.when(F.col("method") == baseline, F.col("value"))).alias("b"),
    )
    delta = F.col("t") - F.col("b")
    return paired.filter(delta.isNotNull()).groupBy("support_size", "metric").agg(
        F.avg(delta * 100).alias("mean_pp"),
        F.coalesce(F.stddev_samp(delta * 100), F.lit(0.0)).alias("std_pp"),
        F.count(F.lit(1)).alias("seeds"),
    )


def backtest_summary(results: DataFrame, limit: float = C.MAX_UNSAFE_RATE) -> DataFrame:
    """H9: per fold and metric mean, deviation and the count of unsafe rates above the limit."""
    return results.groupBy("fold", "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sample_std"),
        F.count("value").alias("runs"),
        count_if((F.col("metric") == "unsafe_decision_rate") & (F.col("value") > limit)).alias("violations"),
    )


def pooled_unsafe_rate(results: DataFrame) -> DataFrame:
    """H14."""
    return results.agg(
        F.sum("unsafe_decisions").alias("unsafe"), F.sum("automated_incidents").alias("automated"),
        (F.sum("unsafe_decisions") / F.sum("automated_incidents")).alias("unsafe_rate"))


def investigator_rows(
    cases: DataFrame, hypotheses: DataFrame, evidence: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Per case: hits of its ranked hypotheses (three at most) and evidence (four at most).

    ``by`` tells trials apart: columns of ``cases`` and ``hypotheses``; evidence has some of them.
    """
    seen = [c for c in by if c in evidence.columns]
    causes = hypotheses.groupBy(*by, "incident_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("cause"))).alias("top_cause"),
        F.collect_list("cause").alias("predicted_causes"))
    cited = evidence.groupBy(*seen, "incident_id").agg(F.collect_list("id").alias("evidence_ids"))
    none = F.array().cast("array<string>")
    rows = cases.join(causes, [*by, "incident_id"], "left").join(cited, [*seen, "incident_id"], "left")
    expected = F.col("expected_root_cause")
    return rows.withColumn(
        "predicted_causes", F.coalesce("predicted_causes", none)
    ).withColumn("evidence_ids", F.coalesce("evidence_ids", none)).withColumn(
        "known", expected.isNotNull() & (expected != "")
    ).withColumn("top_1", F.coalesce(F.col("top_cause") == expected, F.lit(False))).withColumn(
        "top_3", F.coalesce(F.array_contains("predicted_causes", expected), F.lit(False))
    ).withColumn("emitted", F.size("predicted_causes"))


def investigator_metrics(rows: DataFrame) -> DataFrame:
    """Cause accuracy at 1 and 3, evidence recall, share of review decisions."""
    n = F.count(F.lit(1))
    hit = F.coalesce(F.array_contains("evidence_ids", F.col("expected_evidence_id")), F.lit(False))
    return rows.agg(
        n.alias("total_cases"),
        ratio(count_if(F.col("top_1")), n).alias("top_1_root_cause_accuracy"),
        ratio(count_if(F.col("top_3")), n).alias("top_3_root_cause_accuracy"),
        ratio(count_if(hit), n).alias("evidence_recall_at_4"),
        ratio(count_if(F.col("decision") == C.ENGINEER_REVIEW), n).alias("safe_decision_rate"),
    )


def known_unknown_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy on known causes, abstention on unknown ones."""
    known = F.col("known")
    k, u = count_if(known), count_if(~known)
    emitted = F.sum(F.when(known, F.col("emitted")).otherwise(0))
    abstained = count_if(~known & (F.col("emitted") == 0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_cases"), k.alias("known_cases"), u.alias("unknown_cases"),
        ratio(count_if(known & F.col("top_1")), k).alias("known_top_1_accuracy"),
        ratio(count_if(known & F.col("top_3")), k).alias("known_top_3_accuracy"),
        # causes are distinct per case, so at most one of them is the expected one
        ratio(count_if(known & F.col("top_3")), emitted).alias("known_hypothesis_precision"),
        ratio(emitted, k).alias("mean_hypotheses_per_known_case"),
        ratio(abstained, u).alias("unknown_abstention_rate"),
        ratio(u - abstained, u).alias("unknown_unsupported_hypothesis_rate"),
    )


def select_investigation_config(metrics: DataFrame) -> DataFrame:
    """The configuration with the best objective; earlier settings win ties."""
    objective = (
        0.50 * F.col("unknown_abstention_rate") + 0.35 * F.col("known_top_1_accuracy")
        + 0.15 * F.col("known_hypothesis_precision")
    )
    return metrics.withColumn("objective", objective).orderBy(
        F.desc("objective"), F.asc("semantic_weight"), F.asc("minimum_evidence")).limit(1)


def keyword_baseline(incidents: DataFrame, text: str = "log_text") -> DataFrame:
    """The cause with most keyword hits, the first one on ties, none at zero."""
    hits = [
        F.struct(
            sum((F.col(text).contains(w).cast("int") for w in words), F.lit(0)).alias("hits"),
            F.lit(-i).alias("order"), F.lit(cause).alias("cause"))
        for i, (cause, words) in enumerate(C.ROOT_CAUSES.items())
    ]
    best = F.greatest(*hits)
    return incidents.withColumn("_best", best).withColumn(
        "predicted_cause", F.when(F.col("_best.hits") > 0, F.col("_best.cause"))).drop("_best")


def retrieval_baseline(matches: DataFrame, key: str = "query_id") -> DataFrame:
    """Cause of the best match; search an index of incident documents only."""
    return matches.filter(F.col("rank") == 1).select(key, F.col("root_cause").alias("predicted_cause"))


def accuracy(predictions: DataFrame, predicted: str, expected: str) -> DataFrame:
    return predictions.agg(
        ratio(count_if(F.col(predicted) == F.col(expected)), F.count(F.lit(1))).alias("accuracy"))


def demo_holdout_metrics(rows: DataFrame) -> DataFrame:
    """F1 at .5 and cause accuracy, where a row without evidence counts as wrong."""
    anomalous = F.col("is_anomaly") == 1
    hit = F.col("anomaly_p") >= 0.5
    tp = count_if(anomalous & hit)
    right = anomalous & (F.col("evidence_count") > 0) & (F.col("cause") == F.col("true_cause"))
    return rows.agg(
        ratio(2.0 * tp, count_if(anomalous) + count_if(hit)).alias("anomaly_f1"),
        ratio(count_if(right), count_if(anomalous)).alias("top_1_cause_accuracy"),
    )


def long_results(row: dict[str, float | int | None], spark, **tags) -> DataFrame:
    """A10 rows: one (metric, value) per entry of a result dictionary."""
    from logsift.schemas import RESULT

    base = {"experiment": None, "method": None, "seed": None, "support_size": None, "fold": None} | tags
    data = [
        tuple(base[c] for c in ("experiment", "method", "seed", "support_size", "fold"))
        + (name, None if value is None else float(value))
        for name, value in row.items() if value is None or isinstance(value, (int, float))
    ]
    return spark.createDataFrame(data, RESULT)
