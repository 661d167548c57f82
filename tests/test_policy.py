from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from logsift import constants as C
from logsift.functions import risk
from logsift.operators import metrics as H, policy as P


def column(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_grids_hold_the_float_drift():
    assert len(C.F1_GRID) == 17 and 0.20000000000000004 in C.F1_GRID and 0.9000000000000002 in C.F1_GRID
    assert len(C.FINE_GRID) == 91 and len(C.SCORE_QUANTILES) == 100


def test_wilson(spark):
    def bound(e, n, conf=0.95):
        return column(spark, risk.wilson_upper(F.lit(e), F.lit(n), conf))
    assert bound(0, 2000) < 0.05 < bound(0, 10)
    assert bound(5, 100) > bound(0, 100)
    assert bound(0, 0) == 1.0
    assert bound(3, 40, 0.99) == pytest.approx(P.wilson_bound(3, 40, 0.99), abs=1e-15)
    assert P.wilson_bound(0, 50, 0.95) == pytest.approx(
        (lambda z: (z * z / 100 + z * (z * z / 10000) ** 0.5) / (1 + z * z / 50))(NormalDist().inv_cdf(0.95)), abs=1e-12)
    with pytest.raises(Exception, match="errors must be between"):
        bound(11, 10)
    with pytest.raises(ValueError):
        risk.normal_quantile(1.0)
    assert column(spark, risk.risk_acceptable(F.lit(0), F.lit(2000), 0.05))
    assert not column(spark, risk.risk_acceptable(F.lit(0), F.lit(10), 0.05))


def test_ood(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 0.6, 0.7, 0.8, 0.9)], "top_similarity double")
    assert P.ood_threshold(df, 0.20) == pytest.approx(0.58)
    for rate in (0.0, 1.0):
        with pytest.raises(ValueError):
            P.ood_threshold(df, rate)
    with pytest.raises(ValueError):
        P.ood_threshold(df.limit(0))
    got = [column(spark, P.in_distribution(F.lit(v), 0.58)) for v in (0.20, 0.58, 0.80)]
    assert got == [False, True, True]


def test_blend(spark):
    assert [column(spark, risk.blend(F.lit(0.9), F.lit(0.2), w)) for w in (0.0, 1.0)] == [0.2, 0.9]
    with pytest.raises(ValueError):
        risk.blend(F.lit(0.9), F.lit(0.2), 1.1)
    df = spark.createDataFrame(
        [(0, .9, .1), (0, .9, .2), (1, .1, .8), (1, .1, .9)], "label int, source_p double, target_p double")
    best = P.select_blend(df, [0.0, 0.5, 1.0], [0.3, 0.5, 0.7]).first()
    assert (best["source_weight"], best["validation_f1"], best["anomaly_threshold"]) == (0.0, 1.0, 0.3)
    assert [column(spark, risk.probability_confidence(F.lit(p))) for p in (.1, .5, .9)] == [.9, .5, .9]


def scored(spark, rows):
    return spark.createDataFrame(
        rows, "label int, p double, top_similarity double, evidence_label int, unanimous boolean")


def brute(rows, threshold, confs, sims, accept):
    best = None
    for c in sorted(confs):
        for s in sorted(set(sims)):
            auto = [(int(p >= threshold), y) for y, p, sim, e, u in rows
                    if (p if p >= threshold else 1 - p) >= c and sim >= s and u and e == int(p >= threshold)]
            if not auto:
                continue
            errors = sum(a != b for a, b in auto)
            if accept(errors, len(auto)) and (best is None or len(auto) > best[2]):
                best = (c, s, len(auto), errors)
    return best


def test_abstention_matches_brute_force(spark):
    import random
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        y = int(rng.random() < 0.4)
        p = min(1.0, max(0.0, (0.7 if y else 0.3) + rng.gauss(0, 0.2)))
        rows.append((y, p, rng.random(), y if rng.random() < 0.9 else 1 - y, rng.random() < 0.8))
    df = scored(spark, rows).persist()
    found = P.calibrate_abstention(df, 0.5)
    want = brute(rows, 0.5, C.CONFIDENCE_GRID, C.SIMILARITY_GRID, lambda e, n: 1 - (n - e) / n <= 0.05)
    assert (found.confidence_threshold, found.similarity_threshold, found.automated, found.errors) == want
    sims = [0.1, 0.1, 0.3]
    conf = 1 - 0.05 / (10 * 2)
    found = P.calibrate_abstention(df, 0.5, similarity=sims, minimum_automated=50, familywise=0.95, maximum_unsafe=0.12)
    want = brute(rows, 0.5, C.CONFIDENCE_GRID, sims, lambda e, n: n >= 50 and P.wilson_bound(e, n, conf) <= 0.12)
    assert (found.confidence_threshold, found.similarity_threshold, found.automated, found.errors) == want
    with pytest.raises(RuntimeError):
        P.calibrate_abstention(df, 0.5, maximum_unsafe=-1.0)


def test_selective_metrics_with_nothing_automated(spark):
    df = scored(spark, [(1, 0.9, 0.1, 1, True)])
    policy = P.Policy(0.5, 0.5, 0, 0, 0, 0, 0)
    decided = P.triage_decision(df, 0.5, policy, label="label")
    a, b = (H.selective_metrics(decided, empty=e).first() for e in (0.0, None))
    assert a["automated_accuracy"] == 0.0 and b["automated_accuracy"] is None and b["coverage"] == 0.0
    assert decided.first()["recommendation"] == C.NEEDS_REVIEW


def test_average_precision_with_ties(spark):
    rows = [(1, .9), (0, .8), (1, .8), (1, .3), (0, .1)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert H.average_precision(df).first()[0] == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 4) / 3)


def test_first_strict_maximum_wins(spark):
    df = spark.createDataFrame([(1, .9), (0, .1)], "label int, score double")
    assert P.best_f1_threshold(df, C.F1_GRID).first()["threshold"] == C.F1_GRID[1]
