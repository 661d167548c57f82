"""Models, policies and metrics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from checks import section_abc as A, section_de as E, sql as Q, tables as T
from logsift import constants as C
from logsift.functions import risk, text as X
from logsift.operators import features as D, metrics as H, models as M, policy as P, retrieval as R
from logsift.operators import splits, windows
from logsift.plans import feedback, holdout, studies
from logsift.operators.ordering import exact_quantiles
from logsift.sources import readers, writers

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def rounded(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else c for c in df.columns])


def window_incidents(spark, sf, size: int = 3):
    """Windows of alert-log lines with every number masked: doc_id, doc_pos, text, label.

    Studies draw 600 labelled windows, more than the tables have of 20 lines: theirs hold three.
    """
    w = windows.count_windows(
        windows.alert_events(T.alert_log(spark, sf)), F.col("ts"), F.col("event_id"), size=size)
    return w.select(
        F.col("incident_id").alias("doc_id"), F.col("window_number").alias("doc_pos"),
        X.error_template(X.incident_text(F.col("events"), "cross_domain_newline")).alias("text"),
        F.col("is_anomaly").alias("label"))


def block_incidents(spark, sf):
    """One incident per labelled order: the block-log lines of all its items, in order."""
    line = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "value")
    blocks = T.block_log(spark, sf).groupBy("l_orderkey").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(line)), lambda x: X.normalize_cross_domain(x["value"])), "\n").alias("value"))
    o = T.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    return blocks.join(o, "l_orderkey").select(
        F.concat(F.lit("blk-"), F.col("l_orderkey").cast("string")).alias("doc_id"),
        F.col("l_orderkey").alias("doc_pos"), F.col("value").alias("text"), "label")


def labelled_documents(spark, sf):
    return E.masked(spark, sf).join(T.labelled(spark, sf), "doc_id")


# ---- F ------------------------------------------------------------------------------------------
# SQL can't fit a model, but it can say what a fitted one must do: an alert window says so in its text, so
# every window is classified right; at the optimum the weighted residuals of a logistic model add up to nothing.
WINDOWS = f"""{T.NUMBERED}, sized AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY window_number) - 1 AS pos,
    'bgl-window-' || lpad(CAST(window_number AS VARCHAR), 6, '0') AS doc_id FROM windows)"""
# windows of 20 of these events nearly all hold an alert; where both classes matter, windows hold three
SHORT_WINDOWS = WINDOWS.replace("i // 20", "i // 3").replace("count(*) = 20", "count(*) = 3")


def _residual(scored):
    """What must hold for a balanced model over its training rows."""
    return D.class_weights(scored).agg(
        (F.abs(F.sum(F.col("weight") * (F.col("p") - F.col("label")))) < 0.05).alias("optimal"),
        F.count(F.lit(1)).alias("incidents"), F.sum("label").cast("bigint").alias("anomalies"),
        F.sum(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("int")).cast("bigint").alias("classified"))


@query("f1_fit_logistic", f"""WITH {SHORT_WINDOWS}
SELECT true AS optimal, count(*) AS incidents, CAST(sum(is_anomaly) AS BIGINT) AS anomalies, count(*) AS classified FROM windows""")
def _(spark, sf):
    docs = window_incidents(spark, sf).persist()
    model = M.train_text_classifier(docs, D.CLASSIC)
    return _residual(M.score(model, docs).join(docs.select("doc_id", "label"), "doc_id"))


@query("f2_score", f"""WITH {SHORT_WINDOWS}
SELECT doc_id, CAST(is_anomaly AS INTEGER) AS prediction, true AS probability FROM sized WHERE pos >= floor(n * 0.6::DOUBLE)""")
def _(spark, sf):
    split = splits.chronological_split(window_incidents(spark, sf), ["doc_pos"]).persist()
    model = M.train_text_classifier(split.filter("split = 'train'"), D.RETRIEVAL)
    later = split.filter("split <> 'train'")
    return M.score(model, later).select(
        "doc_id", (F.col("p") >= 0.5).cast("int").alias("prediction"), F.col("p").between(0, 1).alias("probability"))


CAUSE_OF = "CASE WHEN {0} % 3 = 0 THEN 'network' WHEN {0} % 3 = 1 THEN 'database' ELSE 'application' END"


def _causes(spark, sf):
    """Anomalous windows that name their cause among their lines."""
    cause = F.expr(CAUSE_OF.format("doc_pos"))
    rows = window_incidents(spark, sf, C.WINDOW_SIZE).filter("label = 1").withColumn("root_cause", cause)
    return rows.withColumn("text", F.concat_ws("\n", "text", F.concat(F.col("root_cause"), F.lit(" unit unavailable"))))


@query("f3_fit_cause_model", f"""WITH {WINDOWS}, c AS (SELECT unnest(['application', 'database', 'network']) AS cause)
SELECT doc_id, {CAUSE_OF.format('window_number')} AS first_cause, 3 AS causes, true AS sums_to_one FROM sized WHERE is_anomaly = 1""")
def _(spark, sf):
    docs = _causes(spark, sf).persist()
    ranked = M.rank_causes(M.fit_cause_model(docs), docs)
    return ranked.groupBy("doc_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("cause"))).alias("first_cause"), F.count(F.lit(1)).cast("int").alias("causes"),
        (F.abs(F.sum("probability") - 1) < 1e-9).alias("sums_to_one"))


STRATIFIED = """drawn AS (SELECT doc_id, is_anomaly, row_number() OVER (PARTITION BY is_anomaly ORDER BY md5('7:' || doc_id), doc_id) - 1 AS k,
    count(*) OVER (PARTITION BY is_anomaly) AS m FROM sized)"""


@query("f4_fit_forest_classifier", f"""WITH {WINDOWS}, {STRATIFIED}
SELECT CAST(is_anomaly AS INTEGER) AS label, count(*) AS incidents, count(*) AS classified FROM drawn WHERE k >= floor(m * 0.75::DOUBLE) GROUP BY 1""")
def _(spark, sf):
    docs = window_incidents(spark, sf, C.WINDOW_SIZE).persist()
    split = splits.stratified_split(docs, (0.75,), ("train", "test"), 7, "doc_id", "label").persist()
    model = M.fit_forest_classifier(split.filter("split = 'train'").drop("split"))
    test = split.filter("split = 'test'")
    scored = M.score(model, test).join(test.select("doc_id", "label"), "doc_id")
    return scored.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("incidents"),
        F.sum(((F.col("p") >= 0.4) == (F.col("label") == 1)).cast("int")).cast("bigint").alias("classified"))


@query("f5_top_features", "SELECT 30 AS terms, 30 AS in_texts, true AS falling, true AS share")
def _(spark, sf):
    docs = window_incidents(spark, sf, C.WINDOW_SIZE).persist()
    found = M.top_features(M.fit_forest_classifier(docs)).persist()
    used = D.term_counts(docs, D.FOREST, ["doc_id"]).select("term").distinct()
    rows = found.collect()  # thirty
    falling = [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    share = 0 < sum(r["importance"] for r in rows) <= 1 + 1e-9
    return spark.createDataFrame([(len(rows), found.join(used, "term").count(), falling, share)], "terms int, in_texts int, falling boolean, share boolean")


@query("f6_normal_only_outliers", f"""WITH {WINDOWS}, {STRATIFIED}
SELECT CAST(is_anomaly AS INTEGER) AS label, count(*) AS incidents, count(*) AS inside, true AS trained_on_normal
FROM drawn WHERE k >= floor(m * 0.8::DOUBLE) GROUP BY 1""")
def _(spark, sf):
    docs = window_incidents(spark, sf, C.WINDOW_SIZE)
    split = splits.stratified_split(docs, (0.6, 0.8), ("train", "validation", "test"), 7, "doc_id", "label").persist()
    normal = split.filter("split = 'train' AND label = 0").select("doc_id", "text")
    space = M.fit_space(normal, D.FOREST)
    forest = M.fit_isolation_forest(D.tfidf(normal, space.vocabulary))
    held = split.filter("split <> 'train'").persist()
    scored = M.isolation_scores(D.tfidf(held.select("doc_id", "text"), space.vocabulary), forest).join(
        held.select("doc_id", "label", "split"), "doc_id").persist()
    validation = scored.filter("split = 'validation'")
    best = P.best_f1_threshold(validation, P.score_quantiles(validation, C.SCORE_QUANTILES)).first()["threshold"]
    roots = forest.filter("node = 0").agg(F.max("size"), F.count(F.lit(1))).first()
    fine = roots[0] == min(M.TREE_ROWS, normal.count()) and roots[1] == 300
    return scored.filter("split = 'test'").groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("incidents"), F.sum(F.col("score").between(0, 1).cast("int")).cast("bigint").alias("inside"),
        (F.lit(fine) & F.lit(0 < best < 1)).alias("trained_on_normal"))


@query("f7_sequence_classifier", f"""WITH {A.TRACES}, s AS (SELECT block_id AS doc_id, CASE WHEN label = 'Fail' THEN 1 ELSE 0 END AS is_anomaly
    FROM traces WHERE label IN ('Success', 'Fail') AND len(steps) > 0),
drawn AS (SELECT *, row_number() OVER (PARTITION BY is_anomaly ORDER BY md5('7:' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY is_anomaly) AS m FROM s)
SELECT CASE WHEN k < floor(m * 0.6::DOUBLE) THEN 'train' WHEN k < floor(m * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS split,
  count(*) AS incidents, CAST(sum(is_anomaly) AS BIGINT) AS anomalies, count(*) AS inside, true AS optimal FROM drawn GROUP BY 1""")
def _(spark, sf):
    docs = M.sequence_documents(readers.event_traces(A._traces(spark, sf)))
    split = splits.stratified_split(docs, (0.6, 0.8), ("train", "validation", "test"), 7, "doc_id", "label").persist()
    model = M.train_text_classifier(split.filter("split = 'train'"), D.DEMO)
    scored = M.score(model, split).join(split.select("doc_id", "label", "split"), "doc_id").persist()
    best = P.best_f1_threshold(scored.filter("split = 'validation'"), C.FINE_GRID, score="p").first()["threshold"]
    fine = _residual(scored.filter("split = 'train'")).first()["optimal"] and 0 < best < 1
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("incidents"), F.sum("label").cast("bigint").alias("anomalies"),
        F.sum(F.col("p").between(0, 1).cast("int")).cast("bigint").alias("inside"), F.lit(fine).alias("optimal"))


@query("f8_blend", f"""WITH {T.SCORED}
SELECT event_id, round(0.25::DOUBLE * p + 0.75::DOUBLE * other_p, 6) AS blended FROM scored""")
def _(spark, sf):
    return T.scored(spark, sf).select(
        "event_id", F.round(risk.blend(F.col("p"), F.col("other_p"), 0.25), 6).alias("blended"))


def _facts(spark, results: dict):
    """What every row of a study must satisfy, whatever its models learnt; one row per run."""
    def fine(r: dict) -> bool:
        done, total = r["automated_incidents"], r["total_incidents"]
        rates = r["automated_accuracy"], r["unsafe_decision_rate"]
        return (
            done + r["abstained_incidents"] == total and abs(r["coverage"] - done / total) < 1e-9
            and (not done or abs(sum(rates) - 1) < 1e-9 and abs(rates[1] - r["unsafe_decisions"] / done) < 1e-9)
            and all(0 <= r[c] <= 1 for c in ("accuracy", "precision", "recall", "f1", "pr_auc") if c in r)
            and ("f1" not in r or not r["precision"] + r["recall"] or abs(r["f1"] - 2 * r["precision"] * r["recall"] / (r["precision"] + r["recall"])) < 1e-9))
    return spark.createDataFrame([(str(run), int(r["total_incidents"]), fine(r)) for run, r in results.items()], "run string, tested bigint, consistent boolean")


def _seeds(run) -> dict:
    """``run(seed)`` gives results by tag; all seeds of the study, tagged seed/tag.

    A seed is many small jobs one after the other, so the seeds' jobs share the cores.
    """
    with ThreadPoolExecutor(len(C.STUDY_SEEDS)) as pool:
        runs = list(pool.map(run, C.STUDY_SEEDS))
    return {f"{seed}/{tag}": row for seed, rows in zip(C.STUDY_SEEDS, runs) for tag, row in rows.items()}


SEEDS = f"seeds(seed) AS (VALUES {Q.values(C.STUDY_SEEDS)})"
SIZED_RUNS = f"""WITH {SEEDS}, sizes(size) AS (VALUES {Q.values(C.SUPPORT_SIZES)}), w AS (SELECT count(*) // 3 AS n FROM events)
SELECT CAST(seed AS INTEGER) || '/' || CAST(size AS INTEGER) AS run, n - CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS tested, true AS consistent FROM seeds, sizes, w"""


@query("f9_transfer_fit", """WITH b AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
SELECT run, n AS tested, true AS consistent FROM b, (VALUES ('abstention'), ('guarded')) r(run)""")
def _(spark, sf):
    found = holdout.transfer_fit(window_incidents(spark, sf).persist(), block_incidents(spark, sf).persist())
    both = found["abstention"]["automated_incidents"] >= found["guarded"]["automated_incidents"] and 0 <= found["no_abstention"]["f1"] <= 1
    return _facts(spark, {k: found[k] for k in ("abstention", "guarded")}).withColumn("consistent", F.col("consistent") & F.lit(both))


@query("f10_few_shot_adapt", SIZED_RUNS)
def _(spark, sf):
    return _facts(spark, studies.few_shot_adapt(block_incidents(spark, sf), window_incidents(spark, sf)))


@query("f11_target_only_few_shot", SIZED_RUNS)
def _(spark, sf):
    return _facts(spark, studies.target_only_few_shot(window_incidents(spark, sf)))


@query("f12_domain_ensemble", f"""WITH {SEEDS}, w AS (SELECT count(*) // 3 AS n FROM events)
SELECT CAST(seed AS INTEGER) || '/600' AS run, n - CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS tested, true AS consistent, true AS chosen FROM seeds, w""")
def _(spark, sf):
    source, target = block_incidents(spark, sf).persist(), window_incidents(spark, sf).persist()
    found = _seeds(lambda seed: {600: holdout.domain_ensemble(source, target, seed)})
    on_grid = all(r["source_weight"] in C.BLEND_WEIGHTS and r["anomaly_threshold"] in C.F1_GRID for r in found.values())
    return _facts(spark, found).withColumn("chosen", F.lit(on_grid))


@query("f13_feedback_candidate", f"""WITH {SHORT_WINDOWS}
SELECT CAST(floor(max(n) * 0.8::DOUBLE) AS BIGINT) AS training_examples, max(n) - CAST(floor(max(n) * 0.8::DOUBLE) AS BIGINT) AS test_examples,
  1.0::DOUBLE AS test_f1, 'HUMAN_APPROVAL_REQUIRED' AS promotion_status FROM sized""".replace("HUMAN_APPROVAL_REQUIRED", C.HUMAN_APPROVAL))
def _(spark, sf):
    docs = window_incidents(spark, sf).select(
        F.col("doc_id").alias("incident_id"), "text", "label", F.col("doc_id").alias("created_at"))
    _, report = feedback.feedback_candidate(docs)
    row = [report[c] for c in ("training_examples", "test_examples", "test_f1", "promotion_status")]
    return spark.createDataFrame([tuple(row)], "training_examples bigint, test_examples bigint, test_f1 double, promotion_status string")


@query("a10_write_results", """SELECT 'events' AS experiment, event_type AS method, 'mean_value' AS metric, round(avg(value), 4) AS value
FROM events GROUP BY 2""")
def _(spark, sf):
    from logsift.schemas import RESULT

    path = A.scratch(spark, "results") + "/data"
    e = T.table(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(F.avg("value").alias("value"))
    rows = e.select(F.lit("events").alias("experiment"), "method", F.lit(7).alias("seed"), F.lit(0).alias("support_size"),
                    F.lit("all").alias("fold"), F.lit("mean_value").alias("metric"), "value")
    writers.write_results(rows, path)
    return spark.read.schema(RESULT).parquet(path).select("experiment", "method", "metric", F.round("value", 4).alias("value"))


@query("a11_save_load_model", f"""WITH {SHORT_WINDOWS}
SELECT doc_id, CAST(is_anomaly AS INTEGER) AS prediction, true AS as_in_memory FROM sized""")
def _(spark, sf):
    from pyspark.ml.classification import LogisticRegressionModel

    docs = window_incidents(spark, sf).persist()
    model = M.train_text_classifier(docs, D.CLASSIC)
    path = A.scratch(spark, "model")
    writers.save_model(path, spark, model.classifier, model.vocabulary, model.vocabulary.terms, 0.5, 0.1)
    classifier, vocabulary, settings = writers.load_model(path, spark, LogisticRegressionModel)
    loaded = M.score(M.TextModel(vocabulary, model.size, classifier), docs)
    both = loaded.join(M.score(model, docs).withColumnRenamed("p", "memory"), "doc_id")
    return both.select("doc_id", (F.col("p") >= settings["anomaly_threshold"]).cast("int").alias("prediction"),
                       (F.abs(F.col("p") - F.col("memory")) < 1e-12).alias("as_in_memory"))


# ---- G ------------------------------------------------------------------------------------------
def sweep_sql(grid, source=T.SCORED, score="p"):
    return f"""WITH {source}, grid(threshold) AS (VALUES {Q.values(grid)}), c AS (
  SELECT threshold, CAST(sum(CASE WHEN {score} >= threshold THEN label ELSE 0 END) AS DOUBLE) AS tp,
    count(*) FILTER ({score} >= threshold) AS predicted, sum(label) AS positives FROM scored, grid GROUP BY 1),
swept AS (SELECT threshold, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN positives > 0 THEN tp / positives ELSE 0 END AS recall,
  CASE WHEN predicted + positives > 0 THEN 2 * tp / (predicted + positives) ELSE 0 END AS f1 FROM c)"""


@query("g1_threshold_sweep", sweep_sql(C.REPORT_THRESHOLDS) + """
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM swept""")
def _(spark, sf):
    swept = P.threshold_sweep(T.scored(spark, sf), C.REPORT_THRESHOLDS, score="p")
    return rounded(swept, "precision", "recall", "f1")


@query("g2_best_f1_threshold", " UNION ALL ".join(
    f"SELECT * FROM ({sweep_sql(g, score='other_p')} SELECT '{n}' AS grid, round(threshold, 6) AS threshold, round(f1, 6) AS f1 "
    "FROM swept ORDER BY swept.f1 DESC, swept.threshold LIMIT 1)" for n, g in (("fine", C.FINE_GRID), ("coarse", C.F1_GRID))))
def _(spark, sf):
    s = T.scored(spark, sf)
    best = [P.best_f1_threshold(s, g, score="other_p").select(
        F.lit(n).alias("grid"), F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))
        for n, g in (("fine", C.FINE_GRID), ("coarse", C.F1_GRID))]
    return best[0].unionByName(best[1])


@query("g3_select_blend", f"""WITH {T.SCORED}, w(source_weight) AS (VALUES {Q.values(C.BLEND_WEIGHTS)}),
g(anomaly_threshold) AS (VALUES {Q.values(C.F1_GRID)}), b AS (
  SELECT source_weight, anomaly_threshold, sum(label) AS y, sum(CASE WHEN hit THEN label ELSE 0 END) AS tp, count(*) FILTER (hit) AS n
  FROM (SELECT *, source_weight * p + (1.0::DOUBLE - source_weight) * other_p >= anomaly_threshold AS hit FROM scored, w, g) GROUP BY 1, 2)
SELECT source_weight, round(anomaly_threshold, 6) AS anomaly_threshold, round(2.0 * tp / (y + n), 6) AS validation_f1
FROM b ORDER BY 2.0::DOUBLE * tp / (y + n) DESC, source_weight, b.anomaly_threshold LIMIT 1""")
def _(spark, sf):
    s = T.scored(spark, sf).withColumnRenamed("p", "source_p").withColumnRenamed("other_p", "target_p")
    return rounded(P.select_blend(s), "anomaly_threshold", "validation_f1")


@query("g4_ood_threshold", f"""WITH {T.SCORED}
SELECT user_id, round(quantile_cont(top_similarity, 0.05), 6) AS cutoff FROM scored GROUP BY 1
UNION ALL SELECT -1, round(quantile_cont(top_similarity, 0.05), 6) FROM scored
UNION ALL SELECT -2, round(quantile_cont(top_similarity, 0.2), 6) FROM scored""")
def _(spark, sf):
    s = T.scored(spark, sf)
    per_user = exact_quantiles(s, "top_similarity", [C.OOD_RATE], ["user_id"]).select(
        F.col("user_id").cast("long").alias("user_id"), F.round(F.element_at("quantiles", 1), 6).alias("cutoff"))
    whole = [(-1, round(P.ood_threshold(s), 6)), (-2, round(P.ood_threshold(s, 0.2), 6))]
    return per_user.unionByName(spark.createDataFrame(whole, "user_id long, cutoff double"))


@query("g5_in_distribution", f"""WITH {T.SCORED}
SELECT event_id, top_similarity >= (SELECT quantile_cont(top_similarity, 0.05) FROM scored) AS inside FROM scored""")
def _(spark, sf):
    s = T.scored(spark, sf)
    return s.select("event_id", P.in_distribution(F.col("top_similarity"), P.ood_threshold(s)).alias("inside"))


@query("g6_decision_confidence", f"""WITH {T.SCORED}
SELECT event_id, round(greatest(p, 1 - p), 6) AS confidence,
  round(CASE WHEN p >= 0.3 THEN p ELSE 1 - p END, 6) AS threshold_confidence FROM scored""")
def _(spark, sf):
    return T.scored(spark, sf).select(
        "event_id", F.round(risk.probability_confidence(F.col("p")), 6).alias("confidence"),
        F.round(risk.threshold_confidence(F.col("p"), 0.3), 6).alias("threshold_confidence"))


def _wilson(e, n, z):
    z2 = repr(z * z)
    return (f"CASE WHEN {n} <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, ({e}::DOUBLE / {n} + {z2}::DOUBLE / (2.0 * {n}) + {z!r}::DOUBLE * "
            f"sqrt((({e}::DOUBLE / {n}) * (1 - {e}::DOUBLE / {n}) + {z2}::DOUBLE / (4.0 * {n})) / {n})) / (1 + {z2}::DOUBLE / {n})) END")


COUNTS = f"""{T.ASSESSED}, counted AS (SELECT user_id, CAST(sum(wrong) AS BIGINT) AS errors, count(*) AS total FROM assessed GROUP BY 1)"""


@query("g7_wilson_upper", f"""WITH {COUNTS}
SELECT user_id, errors, total, round({_wilson('errors', 'total', risk.normal_quantile(0.95))}, 6) AS bound FROM counted""")
def _(spark, sf):
    counted = P.assessed(T.scored(spark, sf), 0.5).groupBy("user_id").agg(
        F.sum("wrong").alias("errors"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("bound", F.round(risk.wilson_upper(F.col("errors"), F.col("total")), 6))


@query("g8_risk_acceptable", f"""WITH {COUNTS}
SELECT user_id, {_wilson('errors', 'total', risk.normal_quantile(0.95))} <= 0.08 AS acceptable FROM counted""")
def _(spark, sf):
    counted = P.assessed(T.scored(spark, sf), 0.5).groupBy("user_id").agg(
        F.sum("wrong").alias("errors"), F.count(F.lit(1)).alias("total"))
    return counted.select("user_id", risk.risk_acceptable(F.col("errors"), F.col("total"), 0.08).alias("acceptable"))


def hybrid_votes(spark, sf, weights):
    found, truth = E.hybrid_search(spark, sf, weights)
    votes = R.evidence_aggregate(found.join(truth, "query_id"), "semantic_weight", "query_id", "true_label")
    return votes.withColumnRenamed("true_label", "label").withColumn(
        "hits3", F.when(F.col("label") == 1, F.col("anomaly_votes")).otherwise(F.col("matches") - F.col("anomaly_votes")))


HYBRID_VOTES = f"""{E.HYBRID}, weights(w) AS (VALUES {Q.values(C.HYBRID_WEIGHTS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY w, query_id ORDER BY round(w * semantic + (1 - w) * lexical, 9) DESC, doc_id DESC) AS rank,
    w * semantic + (1 - w) * lexical AS score FROM both_scores, weights),
votes AS (SELECT w AS semantic_weight, query_id, any_value(truth) AS label, max(score) AS top_similarity,
    max(label) FILTER (rank = 1) AS evidence_label, min(label) = max(label) AS unanimous, sum(CASE WHEN label = truth THEN 1 ELSE 0 END) AS hits3,
    sum(label) AS anomaly_votes, count(*) AS matches FROM r WHERE rank <= 3 GROUP BY 1, 2)"""


@query("g9_calibrate_retrieval_hybrid", f"""WITH {HYBRID_VOTES}, g(threshold) AS (VALUES {Q.values(C.HYBRID_THRESHOLDS)}),
s AS (SELECT semantic_weight, threshold, count(*) AS n, count(*) FILTER (auto) AS a, count(*) FILTER (auto AND evidence_label = label) AS c
  FROM (SELECT *, top_similarity >= threshold AND unanimous AS auto FROM votes, g) GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY semantic_weight ORDER BY a DESC, threshold) AS k FROM s
  WHERE a = 0 OR 1.0::DOUBLE - c::DOUBLE / a <= 0.05::DOUBLE) WHERE k = 1),
pr AS (SELECT semantic_weight, avg(CASE WHEN evidence_label = label THEN 1.0 ELSE 0 END) AS p1, sum(hits3) / sum(matches) AS p3 FROM votes GROUP BY 1)
SELECT semantic_weight, round(p1, 6) AS precision_at_1, round(p3, 6) AS precision_at_3, threshold, round(a::DOUBLE / n, 6) AS coverage,
  round(CASE WHEN a > 0 THEN c::DOUBLE / a WHEN a = 0 THEN 0 END, 6) AS accuracy,
  round(CASE WHEN a > 0 THEN 1 - c::DOUBLE / a WHEN a = 0 THEN 0 END, 6) AS unsafe_rate
FROM pr LEFT JOIN best USING (semantic_weight)""")
def _(spark, sf):
    rows = P.calibrate_retrieval_hybrid(hybrid_votes(spark, sf, C.HYBRID_WEIGHTS).persist())
    return rounded(rows, "precision_at_1", "precision_at_3", "coverage", "accuracy", "unsafe_rate")


@query("g10_calibrate_retrieval_votes", f"""WITH {T.SCORED}, g(threshold) AS (VALUES {Q.values(C.VOTE_THRESHOLDS)}),
p(policy) AS (VALUES ('majority'), ('unanimous')), s AS (
  SELECT threshold, policy, count(*) AS n, count(*) FILTER (auto) AS a, count(*) FILTER (auto AND (anomaly_votes > 1.5) = (label = 1)) AS r
  FROM (SELECT *, top_similarity >= threshold AND (policy = 'majority' OR unanimous) AS auto FROM scored, g, p) GROUP BY 1, 2)
SELECT threshold, policy, round(a::DOUBLE / n, 6) AS coverage, round(CASE WHEN a > 0 THEN r::DOUBLE / a ELSE 0 END, 6) AS accuracy,
  round(CASE WHEN a > 0 THEN (a - r)::DOUBLE / a ELSE 0 END, 6) AS unsafe_rate FROM s""")
def _(spark, sf):
    return rounded(P.calibrate_retrieval_votes(T.scored(spark, sf)), "coverage", "accuracy", "unsafe_rate")


def _policy_sql(similarity_cte, keep, extra=""):
    return f"""WITH {T.ASSESSED}, conf(c) AS (VALUES {Q.values(C.CONFIDENCE_GRID)}), {similarity_cte},
s AS (SELECT c, t, count(*) AS n, count(*) FILTER (auto) AS a, CAST(sum(CASE WHEN auto THEN wrong ELSE 0 END) AS BIGINT) AS e
  FROM (SELECT *, confidence >= c AND top_similarity >= t AND unanimous AND agrees AS auto FROM assessed, conf, sims) GROUP BY 1, 2)
SELECT c AS confidence_threshold, round(t, 6) AS similarity_threshold, round(a::DOUBLE / n, 6) AS coverage,
  round(e::DOUBLE / a, 6) AS unsafe_rate, a AS automated{extra}
FROM s WHERE {keep} ORDER BY s.a DESC, s.c, s.t LIMIT 1"""


QUANTILE_SIMS = """sims AS (SELECT DISTINCT unnest(quantile_cont(top_similarity, [0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE])) AS t FROM scored)"""


def _policy_row(spark, policy, *names):
    values = policy.as_row().asDict()
    row = {"confidence_threshold": policy.confidence_threshold, "automated": policy.automated} | {
        n: round(values[n], 6) for n in ("similarity_threshold", "coverage", "unsafe_rate", *names)}
    return spark.createDataFrame([row], "confidence_threshold double, similarity_threshold double, coverage double, "
                                 "unsafe_rate double, automated bigint" + "".join(f", {n} double" for n in names))


@query("g11_calibrate_abstention_fixed", _policy_sql(
    f"sims(t) AS (VALUES {Q.values(C.SIMILARITY_GRID)})", "a > 0 AND 1.0::DOUBLE - (a - e)::DOUBLE / a <= 0.05::DOUBLE"))
def _(spark, sf):
    return _policy_row(spark, P.calibrate_abstention(T.scored(spark, sf), 0.5))


@query("g12_calibrate_abstention_quantile", _policy_sql(
    QUANTILE_SIMS, "a > 0 AND 1.0::DOUBLE - (a - e)::DOUBLE / a <= 0.05::DOUBLE"))
def _(spark, sf):
    s = T.scored(spark, sf)
    return _policy_row(spark, P.calibrate_abstention(s, 0.5, similarity=P.similarity_candidates(s)[1]))


_Z60 = risk.normal_quantile(1.0 - (1.0 - C.FAMILYWISE_CONFIDENCE) / 60)


@query("g13_calibrate_safety_policy", _policy_sql(
    QUANTILE_SIMS, f"a >= 100 AND {_wilson('e', 'a', _Z60)} <= 0.05::DOUBLE",
    f", round({_wilson('e', 'a', _Z60)}, 6) AS unsafe_upper_bound"))
def _(spark, sf):
    s = T.scored(spark, sf)
    return _policy_row(spark, P.calibrate_safety_policy(s, 0.5), "unsafe_upper_bound")


POLICY = P.Policy(0.55, 0.25, 0.0, 0.0, 0.0, 0, 0)
DECIDED = T.ASSESSED + """, decided AS (SELECT *, CASE WHEN NOT automated THEN 'NEEDS_HUMAN_REVIEW' WHEN prediction = 1 THEN 'LIKELY_ANOMALY'
    ELSE 'LIKELY_NORMAL' END AS recommendation
  FROM (SELECT *, confidence >= 0.55 AND top_similarity >= 0.25 AND unanimous AND agrees AS automated FROM assessed))"""


def decided(spark, sf):
    return P.triage_decision(T.scored(spark, sf), 0.5, POLICY, label="label")


@query("g14_triage_decision", f"""WITH {DECIDED}
SELECT event_id, recommendation, prediction, round(confidence, 6) AS confidence, confidence >= 0.55 AS confidence_passed,
  top_similarity >= 0.25 AS similarity_passed, unanimous, agrees FROM decided""")
def _(spark, sf):
    return decided(spark, sf).select(
        "event_id", "recommendation", "prediction", F.round("confidence", 6).alias("confidence"),
        "confidence_passed", "similarity_passed", "unanimous", "agrees")


@query("g15_retrieval_decision", f"""WITH {E.VOTES}
SELECT query_id, CASE WHEN NOT (top_similarity >= 0.05 AND unanimous) THEN 'NEEDS_HUMAN_REVIEW' WHEN evidence_label = 1 THEN 'LIKELY_ANOMALY'
  ELSE 'LIKELY_NORMAL' END AS recommendation, round(top_similarity, 6) AS top_similarity, evidence_label, unanimous, anomaly_votes FROM votes""")
def _(spark, sf):
    found, _, _ = E.document_search(spark, sf)
    return rounded(R.retrieval_decision(found), "top_similarity")


@query("g16_analyze_decision", f"""WITH {T.SCORED}
SELECT event_id, CASE WHEN ok THEN 'ANALYZED' ELSE 'NEEDS_HUMAN_REVIEW' END AS decision, CASE WHEN ok THEN cause END AS root_cause
FROM (SELECT *, 'cause-' || (event_id % 3) AS cause, least(p, other_p) >= 0.5 AND event_id % 4 > 0 AS ok FROM scored)""")
def _(spark, sf):
    rows = T.scored(spark, sf).select(
        "event_id", F.col("p").alias("anomaly_p"), F.col("other_p").alias("cause_p"),
        F.concat(F.lit("cause-"), (F.col("event_id") % 3).cast("string")).alias("cause"),
        (F.col("event_id") % 4).alias("evidence_count"))
    return P.analyze_decision(rows, 0.5).select("event_id", "decision", "root_cause")


@query("g17_ood_guard", f"""WITH {DECIDED}
SELECT event_id, automated AND top_similarity >= (SELECT quantile_cont(top_similarity, 0.5) FROM scored) AS automated FROM decided""")
def _(spark, sf):
    rows = decided(spark, sf)
    return P.guarded(rows, P.ood_threshold(rows, 0.5)).select("event_id", "automated")


@query("g18_find_review_case", f"""WITH {DECIDED}
SELECT event_id, recommendation FROM decided WHERE recommendation = 'NEEDS_HUMAN_REVIEW' ORDER BY ts, event_id LIMIT 1""")
def _(spark, sf):
    return P.find_review_case(decided(spark, sf), F.col("ts"), F.col("event_id")).select("event_id", "recommendation")


# ---- H ------------------------------------------------------------------------------------------
@query("h1_classification_metrics", f"""WITH {T.ASSESSED}, c AS (SELECT user_id, count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) AS n FROM assessed GROUP BY 1)
SELECT user_id, round((n - fp - fn)::DOUBLE / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def _(spark, sf):
    rows = H.classification_metrics(T.scored(spark, sf), 0.5, ["user_id"], score="p")
    return rounded(rows, "accuracy", "precision", "recall", "f1")


@query("h2_average_precision", f"""WITH {T.SCORED}, g AS (SELECT other_p, sum(label) AS pos, count(*) AS n FROM scored GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (ORDER BY other_p DESC))
SELECT round(sum(pos * tp::DOUBLE / k) / sum(pos), 6) AS average_precision FROM c""")
def _(spark, sf):
    return rounded(H.average_precision(T.scored(spark, sf), score="other_p"), "average_precision")


@query("h3_class_report", f"""WITH {T.ASSESSED}, per AS (SELECT CAST(c AS VARCHAR) AS class, count(*) FILTER (label = c AND prediction = c)::DOUBLE AS tp,
  count(*) FILTER (prediction = c) AS predicted, count(*) FILTER (label = c) AS support FROM assessed, (VALUES (0), (1)) v(c) GROUP BY 1),
m AS (SELECT class, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r,
  coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f, support FROM per)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""")
def _(spark, sf):
    rows = H.class_report(P.assessed(T.scored(spark, sf), 0.5))
    return rounded(rows, "precision", "recall", "f1")


SELECTIVE = """count(*) AS total_incidents, count(*) FILTER (automated) AS automated_incidents,
  count(*) FILTER (NOT automated) AS abstained_incidents, round(count(*) FILTER (automated)::DOUBLE / count(*), 6) AS coverage,
  round({empty}(1 - count(*) FILTER (automated AND wrong = 1)::DOUBLE / nullif(count(*) FILTER (automated), 0){close}, 6) AS automated_accuracy,
  round({empty}count(*) FILTER (automated AND wrong = 1)::DOUBLE / nullif(count(*) FILTER (automated), 0){close}, 6) AS unsafe_decision_rate,
  count(*) FILTER (automated AND wrong = 1) AS unsafe_decisions, round(avg(top_similarity), 6) AS mean_maximum_similarity,
  round(count(*) FILTER (top_similarity = 0)::DOUBLE / count(*), 6) AS zero_similarity_rate"""
SELECTIVE_ZERO = SELECTIVE.replace("{empty}(1 -", "coalesce(1 -").replace("{empty}count", "coalesce(count").replace("{close}", ", 0)")


@query("h4_selective_metrics", f"""WITH {DECIDED} SELECT user_id, {SELECTIVE_ZERO} FROM decided GROUP BY 1""")
def _(spark, sf):
    rows = H.selective_metrics(decided(spark, sf), ["user_id"], empty=0.0)
    return rounded(rows, "coverage", "automated_accuracy", "unsafe_decision_rate", "mean_maximum_similarity", "zero_similarity_rate")


@query("h5_ranking_metrics", f"""WITH {HYBRID_VOTES}
SELECT semantic_weight, round(avg(CASE WHEN evidence_label = label THEN 1.0 ELSE 0 END), 6) AS precision_at_1,
  round(sum(hits3) / sum(matches), 6) AS precision_at_3 FROM votes GROUP BY 1""")
def _(spark, sf):
    found, truth = E.hybrid_search(spark, sf, C.HYBRID_WEIGHTS)
    return rounded(H.ranking_metrics(found.join(truth, "query_id"), ["semantic_weight"]), "precision_at_1", "precision_at_3")


@query("h6_guard_metrics", f"""WITH {DECIDED} SELECT {SELECTIVE_ZERO}, round(quantile_cont(top_similarity, 0.5), 6) AS median_maximum_similarity
FROM (SELECT * REPLACE (automated AND top_similarity >= (SELECT quantile_cont(top_similarity, 0.5) FROM scored) AS automated) FROM decided)""")
def _(spark, sf):
    rows = decided(spark, sf)
    guarded = P.guarded(rows, P.ood_threshold(rows, 0.5))
    return rounded(H.selective_metrics(guarded, empty=0.0, median=True), "coverage", "automated_accuracy", "unsafe_decision_rate",
                   "mean_maximum_similarity", "zero_similarity_rate", "median_maximum_similarity")


def study(spark, sf):
    """lineitem as a seed study: mean value per (seed, size, method, metric, fold)."""
    li = T.table(spark, sf, "lineitem")
    seed = F.element_at(F.array(*[F.lit(s) for s in C.STUDY_SEEDS]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    size = F.element_at(F.array(F.lit(60), F.lit(300), F.lit(600)), (F.col("l_suppkey") % 3 + 1).cast("int"))
    metric = F.when(F.col("l_partkey") % 2 == 0, "f1").otherwise("unsafe_decision_rate")
    return li.groupBy(seed.alias("seed"), size.alias("support_size"), F.col("l_linestatus").alias("method"),
                      metric.alias("metric"), F.concat(F.lit("fold_"), "l_returnflag").alias("fold")).agg(
        F.avg(F.col("l_discount")).alias("value"))


STUDY = """study AS (SELECT [7, 21, 42, 84, 123][1 + l_linenumber % 5] AS seed, [60, 300, 600][1 + l_suppkey % 3] AS support_size,
  l_linestatus AS method, CASE WHEN l_partkey % 2 = 0 THEN 'f1' ELSE 'unsafe_decision_rate' END AS metric, 'fold_' || l_returnflag AS fold,
  avg(l_discount) AS value FROM lineitem GROUP BY ALL)"""


@query("h7_seed_summary", f"""WITH {STUDY} SELECT support_size, method, metric, round(avg(value), 6) AS mean,
  round(coalesce(stddev_samp(value), 0), 6) AS sample_std, {', '.join(f"round(max(value) FILTER (seed = {s}), 6) AS seed_{s}" for s in C.STUDY_SEEDS)}
FROM study GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(H.seed_summary(study(spark, sf)), "mean", "sample_std", *[f"seed_{s}" for s in C.STUDY_SEEDS])


@query("h8_paired_effects", f"""WITH {STUDY}, d AS (SELECT support_size, metric, seed,
  (max(value) FILTER (method = 'O') - max(value) FILTER (method = 'F')) * 100 AS x FROM study GROUP BY 1, 2, 3)
SELECT support_size, metric, round(avg(x), 6) AS mean_pp, round(coalesce(stddev_samp(x), 0), 6) AS std_pp, count(*) AS seeds FROM d GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(H.paired_effects(study(spark, sf), "O", "F"), "mean_pp", "std_pp")


@query("h9_backtest_summary", f"""WITH {STUDY} SELECT fold, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sample_std,
  count(value) AS runs, count(*) FILTER (metric = 'unsafe_decision_rate' AND value > 0.05) AS violations FROM study GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(H.backtest_summary(study(spark, sf)), "mean", "sample_std")


def _cases(spark, sf):
    """orders as evaluation cases: expected and ranked causes from their line items."""
    o = T.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("incident_id"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("c"), (F.col("o_custkey") % 4).cast("string"))).alias("expected_root_cause"),
        F.concat(F.lit("e"), (F.col("o_orderkey") % 5).cast("string")).alias("expected_evidence_id"),
        F.when(F.col("o_orderkey") % 10 > 0, C.ENGINEER_REVIEW).otherwise("AUTO").alias("decision"))
    li = T.table(spark, sf, "lineitem")
    best = li.groupBy(F.col("l_orderkey").alias("incident_id"), F.concat(F.lit("c"), (F.col("l_partkey") % 4).cast("string")).alias("cause")).agg(
        F.max("l_discount").alias("confidence"))
    from logsift.operators.ordering import top_per_group
    causes = top_per_group(best.filter("confidence >= 0.05"), ["incident_id"], [F.desc("confidence"), F.asc("cause")], 3)
    evidence = li.select(F.col("l_orderkey").alias("incident_id"), F.concat(F.lit("e"), (F.col("l_suppkey") % 5).cast("string")).alias("id")).distinct()
    return H.investigator_rows(o, causes, evidence)


CASES = """o AS (SELECT o_orderkey AS incident_id, CASE WHEN o_orderstatus <> 'P' THEN 'c' || (o_custkey % 4) END AS expected,
    'e' || (o_orderkey % 5) AS expected_evidence, o_orderkey % 10 > 0 AS safe FROM orders),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY confidence DESC, cause) AS rank FROM (
  SELECT l_orderkey AS incident_id, 'c' || (l_partkey % 4) AS cause, max(l_discount) AS confidence FROM lineitem GROUP BY 1, 2) WHERE confidence >= 0.05) WHERE rank <= 3),
cases AS (SELECT o.*, expected IS NOT NULL AS known, coalesce(top = expected, false) AS top1, coalesce(list_contains(causes, expected), false) AS top3,
    coalesce(len(causes), 0) AS emitted, coalesce(list_contains(ids, expected_evidence), false) AS hit
  FROM o LEFT JOIN (SELECT incident_id, list(cause) AS causes, max(cause) FILTER (rank = 1) AS top FROM ranked GROUP BY 1) USING (incident_id)
  LEFT JOIN (SELECT l_orderkey AS incident_id, list(DISTINCT 'e' || (l_suppkey % 5)) AS ids FROM lineitem GROUP BY 1) USING (incident_id))"""


@query("h10_investigator_metrics", f"""WITH {CASES} SELECT count(*) AS total_cases, round(count(*) FILTER (top1)::DOUBLE / count(*), 6) AS top_1_root_cause_accuracy,
  round(count(*) FILTER (top3)::DOUBLE / count(*), 6) AS top_3_root_cause_accuracy, round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS evidence_recall_at_4,
  round(count(*) FILTER (safe)::DOUBLE / count(*), 6) AS safe_decision_rate FROM cases""")
def _(spark, sf):
    return rounded(H.investigator_metrics(_cases(spark, sf)), "top_1_root_cause_accuracy", "top_3_root_cause_accuracy",
                   "evidence_recall_at_4", "safe_decision_rate")


KNOWN = """count(*) AS total_cases, count(*) FILTER (known) AS known_cases, count(*) FILTER (NOT known) AS unknown_cases,
  round(count(*) FILTER (known AND top1)::DOUBLE / count(*) FILTER (known), 6) AS known_top_1_accuracy,
  round(count(*) FILTER (known AND top3)::DOUBLE / count(*) FILTER (known), 6) AS known_top_3_accuracy,
  round(count(*) FILTER (known AND top3)::DOUBLE / sum(emitted) FILTER (known), 6) AS known_hypothesis_precision,
  round((sum(emitted) FILTER (known))::DOUBLE / count(*) FILTER (known), 6) AS mean_hypotheses_per_known_case,
  round(count(*) FILTER (NOT known AND emitted = 0)::DOUBLE / count(*) FILTER (NOT known), 6) AS unknown_abstention_rate,
  round(count(*) FILTER (NOT known AND emitted > 0)::DOUBLE / count(*) FILTER (NOT known), 6) AS unknown_unsupported_hypothesis_rate"""
RATES = ("known_top_1_accuracy", "known_top_3_accuracy", "known_hypothesis_precision", "mean_hypotheses_per_known_case",
         "unknown_abstention_rate", "unknown_unsupported_hypothesis_rate")


@query("h11_known_unknown_metrics", f"WITH {CASES} SELECT {KNOWN} FROM cases")
def _(spark, sf):
    return rounded(H.known_unknown_metrics(_cases(spark, sf)), *RATES)


@query("h12_select_from_groups", f"""WITH {CASES}, m AS (SELECT incident_id % 4 AS w, incident_id // 4 % 4 AS t, {KNOWN} FROM cases GROUP BY 1, 2)
SELECT [0.4::DOUBLE, 0.55::DOUBLE, 0.7::DOUBLE, 0.85::DOUBLE][1 + w] AS semantic_weight, [0.2::DOUBLE, 0.26::DOUBLE, 0.32::DOUBLE, 0.38::DOUBLE][1 + t] AS minimum_evidence,
  round(0.5 * unknown_abstention_rate + 0.35 * known_top_1_accuracy + 0.15 * known_hypothesis_precision, 4) AS objective
FROM m ORDER BY 0.5 * unknown_abstention_rate + 0.35 * known_top_1_accuracy + 0.15 * known_hypothesis_precision DESC, w, t LIMIT 1""")
def _(spark, sf):
    w = F.element_at(F.array(*[F.lit(x) for x in C.INVESTIGATION_WEIGHTS]), (F.col("incident_id") % 4 + 1).cast("int"))
    t = F.element_at(F.array(*[F.lit(x) for x in C.INVESTIGATION_EVIDENCE]), (F.floor(F.col("incident_id") / 4) % 4 + 1).cast("int"))
    rows = _cases(spark, sf).withColumn("semantic_weight", w).withColumn("minimum_evidence", t)
    best = H.select_investigation_config(H.known_unknown_metrics(rows, ["semantic_weight", "minimum_evidence"]))
    return best.select("semantic_weight", "minimum_evidence", F.round("objective", 4).alias("objective"))


def _hits(words):
    return " + ".join(f"contains(t, '{w}')::INT" for w in words)


@query("h13_keyword_baseline", f"""WITH e AS (SELECT event_id, lower(CASE event_type WHEN 'error' THEN 'database timeout, connection refused' WHEN 'click' THEN 'DNS host reset'
  WHEN 'view' THEN 'release exception; pool' ELSE 'ok' END || ' ' || props) AS t FROM events),
h AS (SELECT event_id, {', '.join(f"{_hits(w)} AS h{i}" for i, w in enumerate(C.ROOT_CAUSES.values()))} FROM e)
SELECT event_id, CASE WHEN greatest(h0, h1, h2) = 0 THEN NULL WHEN h0 >= h1 AND h0 >= h2 THEN '{list(C.ROOT_CAUSES)[0]}'
  WHEN h1 >= h2 THEN '{list(C.ROOT_CAUSES)[1]}' ELSE '{list(C.ROOT_CAUSES)[2]}' END AS predicted_cause FROM h""")
def _(spark, sf):
    e = T.table(spark, sf, "events")
    text = F.concat_ws(" ", F.when(F.col("event_type") == "error", "database timeout, connection refused")
                       .when(F.col("event_type") == "click", "DNS host reset").when(F.col("event_type") == "view", "release exception; pool")
                       .otherwise("ok"), F.col("props"))
    return H.keyword_baseline(e.select("event_id", F.lower(text).alias("log_text"))).select("event_id", "predicted_cause")


@query("h13_retrieval_baseline", f"""WITH {E.EVIDENCE}, i AS (
  SELECT q.id AS query_id, k.root_cause, k.doc_pos, k.id FROM asked q CROSS JOIN knowledge k WHERE k.kind = 'incident'),
inc AS (SELECT * FROM knowledge_text WHERE kind = 'incident'),
{Q.tfidf('iq', 'asked', 'inc', id_column='id', lower=True, sublinear=False)},
{Q.tfidf('idoc', 'inc', 'inc', id_column='id', lower=True, sublinear=False)}
SELECT query_id AS incident_id, root_cause AS predicted_cause FROM (SELECT i.*, row_number() OVER (PARTITION BY i.query_id
  ORDER BY round(coalesce(s.score, 0), 9) DESC, doc_pos DESC) AS rank FROM i LEFT JOIN (
  SELECT q.id AS query_id, d.id, sum(q.w * d.w) AS score FROM iq q JOIN idoc d USING (term) GROUP BY 1, 2) s USING (query_id, id)) WHERE rank = 1""")
def _(spark, sf):
    from logsift.operators import investigation as I

    index = I.knowledge_index(A._knowledge(spark, sf).filter("kind = 'incident'"), options=D.DEMO)
    queries = E.turn_incidents(spark, sf).withColumnRenamed("incident_id", "query_id").withColumnRenamed("log_text", "text")
    found = R.with_documents(R.search_batch(queries, index, 1), index, "root_cause")
    return H.retrieval_baseline(found).withColumnRenamed("query_id", "incident_id")


@query("h14_pooled_unsafe_rate", f"""WITH {DECIDED} SELECT CAST(sum(wrong) FILTER (automated) AS BIGINT) AS unsafe, count(*) FILTER (automated) AS automated,
  round((sum(wrong) FILTER (automated))::DOUBLE / count(*) FILTER (automated), 6) AS unsafe_rate FROM decided""")
def _(spark, sf):
    runs = H.selective_metrics(decided(spark, sf), ["user_id"])
    return rounded(H.pooled_unsafe_rate(runs), "unsafe_rate")


_FOLDS = " UNION ALL ".join(
    f"SELECT '{name}' AS fold, CAST(floor(n * {last!r}::DOUBLE) AS BIGINT) - CAST(floor(n * {first!r}::DOUBLE) AS BIGINT) AS tested FROM w"
    for name, _, first, last in C.BACKTEST_FOLDS)


@query("h15_temporal_backtest", f"""WITH {SEEDS}, w AS (SELECT count(*) // 3 AS n FROM events), folds AS ({_FOLDS})
SELECT CAST(seed AS INTEGER) || '/' || fold AS run, tested, true AS consistent FROM seeds, folds""")
def _(spark, sf):
    return _facts(spark, studies.temporal_backtest(window_incidents(spark, sf)))


@query("h16_locked_holdout_evaluation", f"""WITH {SEEDS}, w AS (SELECT count(*) // 3 AS n FROM events)
SELECT CAST(CAST(seed AS INTEGER) AS VARCHAR) AS run, n - CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS tested, true AS consistent FROM seeds, w""")
def _(spark, sf):
    split = splits.locked_holdout(window_incidents(spark, sf), number="doc_pos").persist()
    development, locked = (split.filter(F.col("period") == p).drop("period") for p in ("development", "locked"))
    return _facts(spark, studies.locked_holdout_evaluation(development, locked))


@query("h17_retrieval_policy_metrics", f"""WITH {HYBRID_VOTES}, d AS (SELECT *, top_similarity >= 0.05 AND unanimous AS auto FROM votes)
SELECT semantic_weight, round(count(*) FILTER (auto)::DOUBLE / count(*), 6) AS coverage,
  round(coalesce(count(*) FILTER (auto AND evidence_label = label)::DOUBLE / nullif(count(*) FILTER (auto), 0), 0), 6) AS automated_accuracy,
  round(coalesce(count(*) FILTER (auto AND evidence_label <> label)::DOUBLE / nullif(count(*) FILTER (auto), 0), 0), 6) AS unsafe_decision_rate,
  count(*) FILTER (auto AND evidence_label <> label) AS unsafe_decisions FROM d GROUP BY 1""")
def _(spark, sf):
    rows = H.retrieval_policy_metrics(hybrid_votes(spark, sf, C.HYBRID_WEIGHTS), C.DEPLOYED_MINIMUM_SCORE, ["semantic_weight"])
    return rounded(rows, "coverage", "automated_accuracy", "unsafe_decision_rate")


@query("h18_demo_holdout_metrics", f"""WITH {T.SCORED}, d AS (SELECT label, p, event_id % 4 AS ev, event_id % 3 AS cause, user_id % 3 AS truth FROM scored)
SELECT round(2.0 * count(*) FILTER (label = 1 AND p >= 0.5) / (count(*) FILTER (label = 1) + count(*) FILTER (p >= 0.5)), 6) AS anomaly_f1,
  round(count(*) FILTER (label = 1 AND ev > 0 AND cause = truth)::DOUBLE / count(*) FILTER (label = 1), 6) AS top_1_cause_accuracy FROM d""")
def _(spark, sf):
    rows = T.scored(spark, sf).select(
        F.col("label").alias("is_anomaly"), F.col("p").alias("anomaly_p"), (F.col("event_id") % 4).alias("evidence_count"),
        (F.col("event_id") % 3).alias("cause"), (F.col("user_id") % 3).alias("true_cause"))
    return rounded(H.demo_holdout_metrics(rows), "anomaly_f1", "top_1_cause_accuracy")
