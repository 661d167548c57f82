"""Investigation, audit tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import section_abc as A, section_de as E, section_fgh as G, sql as Q, tables as T
from logsift import constants as C
from logsift.functions import text as X, vectors as V
from logsift.operators import audit, investigation as I, metrics as H
from logsift.plans import investigate as plan
from logsift.streaming import counters, triage as stream, windows as stream_windows

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


# ---- I: a user's events are an incident's events ----------------------------------------------
def user_events(spark, sf):
    e = T.table(spark, sf, "events")
    message = F.concat_ws(" ", F.when(F.col("event_type") == "error", "Connection timeout on pool")
                          .when(F.col("event_type") == "click", "validation FAILED after release").otherwise("ok"), F.col("props"))
    return e.select(
        F.col("user_id").cast("string").alias("incident_id"), F.col("event_id").alias("pos"),
        F.when(F.col("event_id") % 11 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("").alias("timestamp"),
        F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("svc-"), (F.col("event_id") % 5).cast("string"))).otherwise("").alias("service"),
        F.lit("INFO").alias("severity"), message.alias("message"))


USER_EVENTS = """ue AS (SELECT CAST(user_id AS VARCHAR) AS incident_id, event_id AS pos,
    CASE WHEN event_id % 11 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '' END AS timestamp,
    CASE WHEN event_id % 7 > 0 THEN 'svc-' || (event_id % 5) ELSE '' END AS service,
    CASE event_type WHEN 'error' THEN 'Connection timeout on pool' WHEN 'click' THEN 'validation FAILED after release' ELSE 'ok' END || ' ' || props AS message
  FROM events), err AS (SELECT *, regexp_matches(message, '(?i)error|fatal|exception|timeout|failed|refused') AS bad FROM ue)"""
SUMMARY = USER_EVENTS + """, modal AS (SELECT incident_id, service FROM (SELECT incident_id, service, row_number() OVER (
    PARTITION BY incident_id ORDER BY count(*) DESC, min(pos)) AS k FROM ue WHERE service <> '' GROUP BY 1, 2) WHERE k = 1),
summary AS (SELECT incident_id, any_value(coalesce(m.service, 'unknown')) AS affected_service, count(*) AS event_count,
    count(*) FILTER (bad) AS error_count, min(timestamp) FILTER (timestamp <> '') AS first_seen, max(timestamp) FILTER (timestamp <> '') AS last_seen
  FROM err LEFT JOIN modal m USING (incident_id) GROUP BY 1)"""


@query("i1_summarize_incidents", f"WITH {SUMMARY} SELECT * FROM summary")
def _(spark, sf):
    return I.incident_summary(user_events(spark, sf))


@query("i1_dominant_errors", rf"""WITH {SUMMARY} SELECT incident_id, rank, template, n FROM (SELECT incident_id,
  regexp_replace(lower(message), '\d+', '<num>', 'g') AS template, count(*) AS n,
  row_number() OVER (PARTITION BY incident_id ORDER BY count(*) DESC, min(pos)) AS rank FROM err WHERE bad GROUP BY 1, 2) WHERE rank <= 3""")
def _(spark, sf):
    return I.dominant_errors(user_events(spark, sf))


def _keywords_sql() -> str:
    fixed = ", ".join(f"('{c}', {o}, -1, {p}, '{w}')" for o, (c, ws) in enumerate(C.ROOT_CAUSES.items()) for p, w in enumerate(ws))
    common = ", ".join(f"'{w}'" for w in C.COMMON_KEYWORDS)
    return f"""tok AS (SELECT root_cause AS cause, 3 + doc_pos AS cause_order, doc_pos, words FROM (
    SELECT root_cause, doc_pos, regexp_extract_all(lower(array_to_string(list_concat([title], symptoms, tags), ' ')), '[a-z][a-z0-9_-]{{2,}}') AS words
    FROM knowledge WHERE root_cause IS NOT NULL)),
kw_rows AS (SELECT * FROM (VALUES {fixed}) f(cause, cause_order, doc_pos, place, word)
  UNION ALL SELECT cause, cause_order, doc_pos, unnest(range(len(words))), unnest(words) FROM tok),
kw_first AS (SELECT cause, word, min(cause_order) AS cause_order, min(doc_pos * 1000000 + place) AS seen FROM kw_rows
  WHERE doc_pos < 0 OR word NOT IN ({common}) GROUP BY 1, 2),
kw AS (SELECT cause, min(cause_order) AS cause_order, list(word ORDER BY seen) AS keywords FROM kw_first GROUP BY 1)"""


@query("i2_cause_keywords", f"""WITH {A.KNOWLEDGE}, {_keywords_sql()}
SELECT cause, CAST(cause_order AS BIGINT) AS cause_order, array_to_string(keywords, ' ') AS keywords FROM kw""")
def _(spark, sf):
    return I.cause_keywords(A._knowledge(spark, sf)).withColumn("keywords", F.array_join("keywords", " "))


@query("i2_keyword_table", f"""WITH {A.KNOWLEDGE}, {_keywords_sql()}
SELECT cause, word, CAST(seen // 1000000 AS BIGINT) AS doc_pos, row_number() OVER (PARTITION BY cause ORDER BY seen) AS place FROM kw_first""".replace(
    "seen // 1000000", "CASE WHEN seen < 0 THEN -1 ELSE seen // 1000000 END"))
def _(spark, sf):
    from logsift.operators.ordering import position_within

    table = I.keyword_table(A._knowledge(spark, sf)).select("cause", "word", "seen")
    placed = position_within(table, ["cause"], F.col("seen"), F.col("word"), name="place")
    return placed.select("cause", "word", F.col("seen.doc_pos").alias("doc_pos"), (F.col("place") + 1).alias("place"))


def deployments(spark, sf):
    o = T.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"),
                    F.concat(F.lit("svc-"), (F.col("o_custkey") % 4).cast("string")).alias("service"),
                    F.col("o_orderpriority").alias("summary"))


@query("i3_correlate_deployments", f"""WITH {SUMMARY}, d AS (SELECT 'svc-' || (o_custkey % 4) AS service, CAST(o_orderkey AS VARCHAR) AS id FROM orders)
SELECT incident_id, affected_service AS service, count(*) AS deployments, min(id) AS first_id, max(id) AS last_id
FROM summary JOIN d ON service = affected_service GROUP BY 1, 2""")
def _(spark, sf):
    return I.correlate_deployments(I.incident_summary(user_events(spark, sf)), deployments(spark, sf))


def _last_sql(own: str) -> str:
    stamp = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
    org = f"coalesce({E.TENANT.format('user_id')}, '') AS organization"
    return f"""WITH d AS (SELECT {org}, 'svc-' || (user_id % 5) AS service, {stamp} AS deployed_at, max(CAST(event_id AS VARCHAR)) AS id
  FROM events WHERE event_type = 'click' GROUP BY 1, 2, 3),
i AS (SELECT {org}, event_id AS incident_id, 'svc-' || (event_id % 5) AS service, {stamp} AS first_seen FROM events)
SELECT {own}, i.incident_id, i.service, i.first_seen, d.id AS deployment_id, d.deployed_at FROM i ASOF LEFT JOIN d
  ON i.organization = d.organization AND i.service = d.service AND i.first_seen >= d.deployed_at"""


@query("i3_last_deployment", _last_sql("i.organization"))
def _(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    e = T.table(spark, sf, "events").withColumn("organization", E.tenant("user_id"))
    service = lambda c: F.concat(F.lit("svc-"), (F.col(c) % 5).cast("string"))
    released = e.filter("event_type = 'click'").select(
        "organization", F.col("event_id").cast("string").alias("id"), service("user_id").alias("service"), stamp.alias("deployed_at"))
    incidents = e.select("organization", F.col("event_id").alias("incident_id"), service("event_id").alias("affected_service"), stamp.alias("first_seen"))
    return I.last_deployments(incidents, released, ("organization",))


@query("i3_deployment_context", f"""WITH {SUMMARY} SELECT CAST(o_orderkey AS VARCHAR) AS id, 'svc-' || (o_custkey % 4) AS service, o_orderpriority AS summary
FROM orders WHERE 'svc-' || (o_custkey % 4) IN (SELECT affected_service FROM summary)""")
def _(spark, sf):
    return I.deployment_context(I.incident_summary(user_events(spark, sf)), deployments(spark, sf)).select("id", "service", "summary")


def turn_events(spark, sf):
    """One event per conversation turn, matching the incidents of the knowledge search."""
    return E.turn_queries(spark, sf).select(
        F.col("query_id").cast("string").alias("incident_id"), F.lit(0).alias("pos"), F.lit("").alias("timestamp"),
        F.concat(F.lit("svc-"), (F.col("query_id") % 7).cast("string")).alias("service"), F.lit("").alias("severity"),
        F.col("text").alias("message"))


HYPOTHESES = f"""{E.EVIDENCE}, {_keywords_sql()}, ev AS (SELECT incident_id, root_cause AS cause, max(hybrid_similarity) AS s,
    string_agg(id, ',' ORDER BY rank) AS ids FROM evidence WHERE root_cause IS NOT NULL GROUP BY 1, 2 HAVING max(hybrid_similarity) >= 0.05),
hyp AS (SELECT incident_id, cause, ids, keywords, round(least(0.45 * (len(list_filter(keywords, lambda w: contains(text, w))) / len(keywords)) + 0.4 * s
    + CASE WHEN cause = 'recent_deployment_regression' THEN 0.15 ELSE 0 END, 0.99), 4) AS confidence, cause_order
  FROM ev JOIN kw USING (cause) JOIN asked a ON a.id = incident_id),
hypotheses AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY confidence DESC, cause_order) AS rank FROM hyp) WHERE rank <= 3)"""


def investigation(spark, sf):
    # lexical search, and a threshold low enough for the prose of the test tables
    return plan.investigate(
        E.turn_incidents(spark, sf), turn_events(spark, sf), A._knowledge(spark, sf), deployments(spark, sf),
        semantic_weight=0.0, minimum_evidence=0.05)


@query("i4_rank_hypotheses", f"""WITH {HYPOTHESES} SELECT incident_id, rank, cause, round(confidence, 3) AS confidence, ids AS evidence_ids FROM hypotheses""")
def _(spark, sf):
    rows = investigation(spark, sf).hypotheses
    return rows.select("incident_id", "rank", "cause", F.round("confidence", 3).alias("confidence"),
                       F.array_join("evidence_ids", ",").alias("evidence_ids"))


CHECKS = HYPOTHESES + """, words AS (SELECT incident_id, list(cause) AS causes, flatten(list(keywords)) AS ws FROM hypotheses GROUP BY 1),
books AS (SELECT e.*, unnest(steps) AS step, unnest(range(len(steps))) AS place FROM evidence e JOIN words w USING (incident_id)
  WHERE kind = 'runbook' AND (coalesce(list_contains(causes, root_cause), false) OR len(list_filter(ws, lambda k: contains(lower(title), k))) > 0)),
steps AS (SELECT incident_id, step, min(rank * 1000 + place) AS spot, arg_min(id, rank * 1000 + place) AS source_id FROM books GROUP BY 1, 2),
plan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY spot) AS rank FROM steps) WHERE rank <= 6)"""


@query("i5_plan_checks", f"WITH {CHECKS} SELECT incident_id, rank, step, source_id FROM plan")
def _(spark, sf):
    return investigation(spark, sf).checks


@query("i6_investigate", f"""WITH {CHECKS} SELECT a.id AS incident_id, 'ENGINEER_REVIEW_REQUIRED' AS decision,
  coalesce(e.n, 0) AS evidence, coalesce(h.cause, '') AS cause, coalesce(p.n, 0) AS checks FROM asked a
  LEFT JOIN (SELECT incident_id, count(*) AS n FROM evidence GROUP BY 1) e ON e.incident_id = a.id
  LEFT JOIN (SELECT incident_id, cause FROM hypotheses WHERE rank = 1) h ON h.incident_id = a.id
  LEFT JOIN (SELECT incident_id, count(*) AS n FROM plan GROUP BY 1) p ON p.incident_id = a.id""")
def _(spark, sf):
    done = investigation(spark, sf)
    counted = lambda df, n: df.groupBy("incident_id").agg(F.count(F.lit(1)).alias(n))
    first = done.hypotheses.filter("rank = 1").select("incident_id", "cause")
    zero = F.lit(0).cast("bigint")
    return (
        done.decisions.join(counted(done.evidence, "evidence"), "incident_id", "left").join(first, "incident_id", "left")
        .join(counted(done.checks, "checks"), "incident_id", "left")
        .select("incident_id", "decision", F.coalesce("evidence", zero).alias("evidence"),
                F.coalesce("cause", F.lit("")).alias("cause"), F.coalesce("checks", zero).alias("checks")))


@query("i6_tenant_investigation", E.per_tenant(CHECKS, """a.id AS incident_id, coalesce(e.n, 0) AS evidence,
  coalesce(h.cause, '') AS cause, coalesce(p.n, 0) AS checks, CAST(a.id AS BIGINT) % 7 // 2 = {t} AS deployed FROM asked a
  LEFT JOIN (SELECT incident_id, count(*) AS n FROM evidence GROUP BY 1) e ON e.incident_id = a.id
  LEFT JOIN (SELECT incident_id, cause FROM hypotheses WHERE rank = 1) h ON h.incident_id = a.id
  LEFT JOIN (SELECT incident_id, count(*) AS n FROM plan GROUP BY 1) p ON p.incident_id = a.id"""))
def _(spark, sf):
    incidents = E.tenant_incidents(spark, sf)
    key, zero = ["organization", "incident_id"], F.lit(0).cast("bigint")
    events = incidents.select(
        *key, F.lit(0).alias("pos"), F.lit("").alias("timestamp"), F.lit("").alias("severity"),
        F.concat(F.lit("svc-"), (F.col("incident_id").cast("bigint") % 7).cast("string")).alias("service"),
        F.col("log_text").alias("message"))
    # two services of its own for each tenant, so a deployment of another tenant would show
    turn = F.col("o_orderkey") % 3
    deployed = T.table(spark, sf, "orders").select(
        E.tenant("o_orderkey").alias("organization"), F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("svc-"), (turn * 2 + F.col("o_custkey") % 2).cast("string")).alias("service"), F.col("o_orderpriority").alias("summary"))
    done = plan.investigate(incidents, events, E.tenant_knowledge(spark, sf), deployed,
                            semantic_weight=0.0, minimum_evidence=0.05, scope=("organization",))
    counted = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    return (
        done.decisions.join(counted(done.evidence, "evidence"), key, "left")
        .join(done.hypotheses.filter("rank = 1").select(*key, "cause"), key, "left")
        .join(counted(done.checks, "checks"), key, "left").join(counted(done.deployments, "n"), key, "left")
        .select(*key, F.coalesce("evidence", zero).alias("evidence"), F.coalesce("cause", F.lit("")).alias("cause"),
                F.coalesce("checks", zero).alias("checks"), (F.coalesce("n", zero) > 0).alias("deployed")))


@query("i7_evidence_ledger", f"""WITH {E.EVIDENCE} SELECT incident_id, id, kind, title, array_to_string(steps, '|') AS steps FROM evidence""")
def _(spark, sf):
    ledger = I.evidence_ledger(E.turn_evidence(spark, sf))
    return ledger.select("incident_id", "id", "kind", "title", F.array_join("steps", "|").alias("steps"))


CITED = f"""{E.EVIDENCE}, n AS (SELECT id AS incident_id, text,
    ['KB-' || (CAST(id AS BIGINT) % 40), 'KB-' || (length(text) % 40)] AS cited FROM asked),
bad AS (SELECT incident_id, count(DISTINCT c) AS unsupported FROM (SELECT incident_id, unnest(cited) AS c FROM n) x
  WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.incident_id = x.incident_id AND e.id = x.c) GROUP BY 1)"""
OUTCOME = """incident_id, coalesce(unsupported, 0) AS unsupported, CASE WHEN coalesce(unsupported, 0) > 0 THEN 'outside ledger'
  WHEN length(text) % 3 = 0 THEN 'incomplete' ELSE 'accepted' END AS outcome FROM n LEFT JOIN bad USING (incident_id)"""


def _explanations(incidents, *scope):
    size = F.length("log_text")
    return incidents.select(
        *scope, F.col("incident_id").alias("output_id"), "incident_id", F.col("log_text").alias("explanation"),
        F.when(size % 3 == 0, " ").otherwise("some").alias("uncertainty"),
        F.array(F.concat(F.lit("KB-"), (F.col("incident_id").cast("bigint") % 40).cast("string")),
                F.concat(F.lit("KB-"), (size % 40).cast("string"))).alias("cited_evidence_ids"))


@query("i8_validate_citations", f"WITH {CITED} SELECT {OUTCOME}")
def _(spark, sf):
    checked = I.validate_citations(_explanations(E.turn_incidents(spark, sf)), I.evidence_ledger(E.turn_evidence(spark, sf)))
    return checked.select("incident_id", "unsupported", F.coalesce("reason", F.lit("accepted")).alias("outcome"))


def _tenant_ledger(spark, sf):
    index = I.knowledge_index(E.tenant_knowledge(spark, sf), scope=("organization",))
    return I.evidence_ledger(I.knowledge_evidence(E.tenant_incidents(spark, sf), index, semantic_weight=0.0), ("organization",))


@query("i7_tenant_ledger", E.per_tenant(E.EVIDENCE, "incident_id, id, kind, title, array_to_string(steps, '|') AS steps FROM evidence"))
def _(spark, sf):
    return _tenant_ledger(spark, sf).select("organization", "incident_id", "id", "kind", "title", F.array_join("steps", "|").alias("steps"))


@query("i8_tenant_citations", E.per_tenant(CITED, OUTCOME))
def _(spark, sf):
    outputs = _explanations(E.tenant_incidents(spark, sf), "organization")
    checked = I.validate_citations(outputs, _tenant_ledger(spark, sf), ("organization",))
    return checked.select("organization", "incident_id", "unsupported", F.coalesce("reason", F.lit("accepted")).alias("outcome"))


@query("i9_tenant_knowledge", f"""WITH {A.KNOWLEDGE} SELECT 'ARCH-' || s_name AS id, 'architecture' AS kind, 'Service context for ' || s_name AS title,
  array_to_string(list_filter([s_name, n_name, 'dep-' || (s_suppkey % 3)], lambda x: x <> ''), '|') AS tags FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT id, kind, title, array_to_string(CASE WHEN len(tags) = len(list_distinct(tags)) THEN tags
  WHEN tags[1] = tags[2] THEN list_distinct([tags[1]]) || CASE WHEN tags[3] = tags[1] THEN [] ELSE [tags[3]] END
  ELSE [tags[1], tags[2]] END, '|') FROM knowledge""")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").join(
        F.broadcast(T.table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    dependency = F.concat(F.lit("dep-"), (F.col("s_suppkey") % 3).cast("string"))
    services = s.select(F.concat(F.lit(" "), "s_name").alias("name"), F.lit("").alias("description"),
                        F.col("n_name").alias("owner"), F.array(dependency, F.lit(" "), dependency).alias("dependencies"))
    both = I.tenant_knowledge(services, A._knowledge(spark, sf))
    return both.select("id", "kind", "title", F.array_join("tags", "|").alias("tags"))


def _trials_sql(tail: str) -> str:
    tfidf = lambda name, of: Q.tfidf(name, of, "knowledge_text", id_column="id", lower=True, sublinear=False, stop=C.ENGLISH_STOP_WORDS)
    return f"""WITH {A.KNOWLEDGE}, asked AS (SELECT CAST(conv_id * 100000 + turn AS VARCHAR) AS id, conv_id, lower(text) AS text,
    CASE WHEN conv_id % 3 > 0 THEN 'cause-' || (conv_id % 5 * 2) END AS expected FROM conversations WHERE trim(text) <> ''),
{tfidf('qv', 'asked')}, {tfidf('dv', 'knowledge_text')}, {_keywords_sql()},
unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
lex AS (SELECT q.id AS query_id, d.id, sum(q.w * d.w) AS s FROM qv q JOIN dv d USING (term) GROUP BY 1, 2),
pairs AS (SELECT a.id AS incident_id, k.doc_pos, k.root_cause, coalesce(list_dot_product(ua.e, uk.e), 0.0) AS sem, coalesce(lex.s, 0.0) AS lex
  FROM asked a CROSS JOIN knowledge k LEFT JOIN unit ua ON ua.vec_id = a.conv_id LEFT JOIN unit uk ON uk.vec_id = k.doc_pos
  LEFT JOIN lex ON lex.query_id = a.id AND lex.id = k.id),
weights(w) AS (VALUES {Q.values(C.INVESTIGATION_WEIGHTS)}), thresholds(t) AS (VALUES {Q.values(C.INVESTIGATION_EVIDENCE)}),
found AS (SELECT *, row_number() OVER (PARTITION BY w, incident_id ORDER BY round(score, 9) DESC, doc_pos DESC) AS rank
  FROM (SELECT *, w * sem + (1.0::DOUBLE - w) * lex AS score FROM pairs, weights)),
ev AS (SELECT w, incident_id, root_cause AS cause, max(round(score, 4)) AS s FROM found WHERE rank <= 4 AND score > 0 AND root_cause IS NOT NULL GROUP BY 1, 2, 3),
hyp AS (SELECT w, t, incident_id, cause, cause_order,
    round(least(0.45 * (len(list_filter(keywords, lambda k: contains(text, k))) / len(keywords)) + 0.4 * s, 0.99), 4) AS confidence
  FROM ev JOIN thresholds ON s >= t JOIN kw USING (cause) JOIN asked a ON a.id = incident_id),
best AS (SELECT w, t, incident_id, list(cause) AS causes, max(cause) FILTER (rank = 1) AS first FROM (
  SELECT *, row_number() OVER (PARTITION BY w, t, incident_id ORDER BY confidence DESC, cause_order) AS rank FROM hyp) WHERE rank <= 3 GROUP BY 1, 2, 3),
judged AS (SELECT w, t, expected IS NOT NULL AS known, coalesce(first = expected, false) AS top1, coalesce(list_contains(causes, expected), false) AS top3,
    coalesce(len(causes), 0) AS emitted
  FROM (SELECT id AS incident_id, expected FROM asked) CROSS JOIN weights CROSS JOIN thresholds LEFT JOIN best USING (w, t, incident_id)),
trials AS (SELECT w AS semantic_weight, t AS minimum_evidence, {G.KNOWN} FROM judged GROUP BY 1, 2)
{tail}"""


def _trials(spark, sf):
    """Every conversation turn as a case under all sixteen configurations."""
    unit = T.vectors(spark, sf).select(F.col("vec_id").alias("_vec"), V.unit_vector(F.col("embedding")).alias("embedding"))
    turns = T.table(spark, sf, "conversations").filter(F.trim("text") != "")
    cases = turns.select(
        (F.col("conv_id") * 100000 + F.col("turn")).cast("string").alias("incident_id"), F.lower("text").alias("log_text"), F.col("conv_id").alias("_vec"),
        F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("cause-"), (F.col("conv_id") % 5 * 2).cast("string"))).alias("expected_root_cause"))
    known = A._knowledge(spark, sf).withColumn("_vec", F.col("doc_pos")).join(unit, "_vec", "left").drop("_vec")
    return plan.configuration_trials(cases.join(unit, "_vec", "left").drop("_vec"), turn_events(spark, sf), known, deployments(spark, sf))


@query("h12_configuration_trials", _trials_sql("SELECT * REPLACE (coalesce(known_hypothesis_precision, 0) AS known_hypothesis_precision) FROM trials"))
def _(spark, sf):
    trials = _trials(spark, sf)
    return trials.select(*[F.round(c, 6).alias(c) if c in G.RATES else c for c in trials.columns])


@query("h12_select_investigation_config", _trials_sql("""SELECT semantic_weight, minimum_evidence,
  round(0.5 * unknown_abstention_rate + 0.35 * known_top_1_accuracy + 0.15 * coalesce(known_hypothesis_precision, 0), 4) AS objective
FROM trials ORDER BY round(0.5 * unknown_abstention_rate + 0.35 * known_top_1_accuracy + 0.15 * coalesce(known_hypothesis_precision, 0), 9) DESC, 1, 2 LIMIT 1"""))
def _(spark, sf):
    best = H.select_investigation_config(_trials(spark, sf))
    return best.select("semantic_weight", "minimum_evidence", F.round("objective", 4).alias("objective"))


# ---- A7-A9, J --------------------------------------------------------------------------------------
def decisions(spark, sf):
    e = T.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("decision_id"), F.concat(F.lit("inc-"), F.col("user_id").cast("string")).alias("incident_id"),
        F.when(F.col("event_id") % 2 == 0, "hdfs_hybrid_retrieval").otherwise("bgl_evidence_grounded_triage").alias("source"),
        F.when(F.col("event_type") == "error", C.LIKELY_ANOMALY).when(F.col("event_type") == "view", C.NEEDS_REVIEW)
        .otherwise(C.LIKELY_NORMAL).alias("recommendation"),
        "value", F.col("ts").alias("created_at"))


DECISIONS = """decisions AS (SELECT event_id AS decision_id, 'inc-' || user_id AS incident_id,
    CASE WHEN event_id % 2 = 0 THEN 'hdfs_hybrid_retrieval' ELSE 'bgl_evidence_grounded_triage' END AS source,
    CASE event_type WHEN 'error' THEN 'LIKELY_ANOMALY' WHEN 'view' THEN 'NEEDS_HUMAN_REVIEW' ELSE 'LIKELY_NORMAL' END AS recommendation,
    value, ts AS created_at FROM events)"""


@query("a7_append_decisions", f"""WITH {DECISIONS} SELECT source, recommendation, count(*) AS decisions, count(*) AS ids FROM decisions GROUP BY 1, 2""")
def _(spark, sf):
    path = A.scratch(spark, "decisions") + "/data"
    rows = decisions(spark, sf).withColumn("incident_id", F.concat_ws("-", "incident_id", "decision_id")).drop("decision_id", "created_at")
    for _ in range(2):  # a retried batch leaves one copy
        audit.append_decisions(rows, path, "7")
    return spark.read.parquet(path).groupBy("source", "recommendation").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_distinct("decision_id").alias("ids"))


def feedback(spark, sf):
    docs = T.documents(spark, sf).join(T.labelled(spark, sf), "doc_id", "left")
    number = F.col("doc_id")
    return docs.select(
        number.cast("string").alias("incident_id"), F.col("lang").alias("organization_id"),
        F.when(number % 13 == 0, "MAYBE").when(F.col("label") == 1, "ANOMALY").when(F.col("label") == 0, "NORMAL")
        .when(number % 2 == 0, "UNCERTAIN").alias("final_anomaly_label"),
        F.when(number % 8 < 7, (number % 8).cast("smallint")).alias("usefulness_rating"),
        F.transform(F.split("text", "\n"), lambda m: F.struct(m.alias("message"))).alias("incident_events"),
        F.lpad(number.cast("string"), 9, "0").alias("created_at"))


FEEDBACK = f"""{T.LABELLED}, feedback AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS incident_id, lang AS organization_id, text,
    CASE WHEN doc_id % 13 = 0 THEN 'MAYBE' WHEN label = 1 THEN 'ANOMALY' WHEN label = 0 THEN 'NORMAL' WHEN doc_id % 2 = 0 THEN 'UNCERTAIN' END AS final_anomaly_label,
    CASE WHEN doc_id % 8 < 7 THEN doc_id % 8 END AS rating, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS created_at
  FROM documents LEFT JOIN labelled USING (doc_id))"""


@query("a8_append_feedback", f"""WITH {FEEDBACK} SELECT incident_id, concat_ws(',', CASE WHEN final_anomaly_label = 'MAYBE' THEN 'final_anomaly_label' END,
  CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'usefulness_rating' END) AS failed FROM feedback""")
def _(spark, sf):
    path = A.scratch(spark, "feedback")
    audit.append_feedback(feedback(spark, sf), path + "/valid", path + "/quarantine")
    valid = spark.read.parquet(path + "/valid").select("incident_id", F.lit("").alias("failed"))
    return valid.unionByName(spark.read.parquet(path + "/quarantine").select(
        "incident_id", F.array_join("failed", ",").alias("failed")))


@query("a9_upsert_profiles", """WITH cur AS (SELECT c_custkey AS k, c_mktsegment AS name, 1 + c_nationkey AS v FROM customer),
inc AS (SELECT o_custkey * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END AS k, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS name FROM orders GROUP BY 1)
SELECT coalesce(cur.k, inc.k) AS organization_id, coalesce(inc.name, cur.name) AS display_name,
  CAST(CASE WHEN cur.k IS NULL THEN 1 WHEN inc.k IS NOT NULL THEN v + 1 ELSE v END AS INTEGER) AS knowledge_version, inc.k IS NOT NULL AS updated
FROM cur FULL OUTER JOIN inc ON cur.k = inc.k""")
def _(spark, sf):
    old = F.lit("2024-01-01 00:00:00").cast("timestamp")
    current = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("organization_id"), F.col("c_mktsegment").alias("display_name"),
        (F.col("c_nationkey") + 1).alias("knowledge_version"), old.alias("created_at"), old.alias("updated_at"))
    incoming = audit.last_per_key(T.table(spark, sf, "orders").select(
        # a fifth of the orders name organizations that the snapshot doesn't have
        (F.col("o_custkey") * F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(1)).alias("organization_id"),
        F.col("o_orderpriority").alias("display_name"), "o_orderdate", "o_orderkey"),
        "organization_id", "o_orderdate", "o_orderkey")
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    merged = audit.upsert_profiles(current, incoming, now)
    return merged.select("organization_id", "display_name", "knowledge_version", (F.col("updated_at") == now).alias("updated"))


@query("j1_decision_queue", f"""WITH {DECISIONS} SELECT decision_id, incident_id, created_at FROM decisions
WHERE recommendation = 'NEEDS_HUMAN_REVIEW' AND source = 'hdfs_hybrid_retrieval' ORDER BY created_at DESC, decision_id DESC LIMIT 100""")
def _(spark, sf):
    return audit.decision_queue(decisions(spark, sf), C.NEEDS_REVIEW, "hdfs_hybrid_retrieval", 100).select(
        "decision_id", "incident_id", "created_at")


@query("j2_feedback_list", f"WITH {FEEDBACK} SELECT incident_id, organization_id FROM feedback ORDER BY created_at DESC, incident_id DESC LIMIT 20")
def _(spark, sf):
    return audit.feedback_list(feedback(spark, sf)).select("incident_id", "organization_id")


@query("j3_verified_feedback", f"""WITH {FEEDBACK} SELECT incident_id, final_anomaly_label FROM feedback
WHERE organization_id = 'en' AND final_anomaly_label IN ('ANOMALY', 'NORMAL') """)
def _(spark, sf):
    return audit.verified_feedback(feedback(spark, sf), "en").select("incident_id", "final_anomaly_label")


def profiles(spark, sf):
    c = T.table(spark, sf, "customer")
    items = lambda n: F.slice(F.array(*[F.lit(f"s{i}") for i in range(8)]), F.lit(1), (F.col("c_custkey") % n).cast("int"))
    return c.select(
        F.concat(F.lit("org-"), F.col("c_custkey").cast("string")).alias("organization_id"), F.col("c_name").alias("display_name"),
        F.col("c_nationkey").alias("knowledge_version"), items(5).alias("services"), items(7).alias("knowledge"),
        items(3).alias("deployments"), F.col("c_acctbal").alias("updated_at"))


@query("j4_profile", "SELECT 'org-' || c_custkey AS organization_id, c_name AS display_name FROM customer WHERE 'org-' || c_custkey = 'org-77'")
def _(spark, sf):
    return audit.profile(profiles(spark, sf), "org-77").select("organization_id", "display_name")


@query("j5_profile_listing", """SELECT 'org-' || c_custkey AS organization_id, c_name AS display_name, c_nationkey AS knowledge_version,
  CAST(c_custkey % 5 AS INTEGER) AS service_count, CAST(c_custkey % 7 AS INTEGER) AS knowledge_document_count,
  CAST(c_custkey % 3 AS INTEGER) AS deployment_count, c_acctbal AS updated_at FROM customer ORDER BY c_acctbal DESC, 1 LIMIT 50""")
def _(spark, sf):
    return audit.profile_listing(profiles(spark, sf))


@query("j6_learning_examples", f"""WITH {FEEDBACK}, l AS (SELECT incident_id, CASE final_anomaly_label WHEN 'ANOMALY' THEN 1 ELSE 0 END AS label, created_at,
    unnest(string_split(text, chr(10))) AS m, unnest(range(len(string_split(text, chr(10))))) AS pos FROM feedback WHERE final_anomaly_label IN ('ANOMALY', 'NORMAL'))
SELECT incident_id, label, created_at, md5(string_agg({Q.strip('m')}, ' ' ORDER BY pos)) AS content FROM l WHERE {Q.strip('m')} <> '' GROUP BY 1, 2, 3""")
def _(spark, sf):
    return audit.learning_examples(feedback(spark, sf)).select("incident_id", "label", "created_at", F.md5("text").alias("content"))


@query("j7_decision_counters", f"""WITH {DECISIONS} SELECT source, recommendation, count(*) AS requests,
  count(*) FILTER (recommendation = 'NEEDS_HUMAN_REVIEW') AS human_reviews FROM decisions GROUP BY 1, 2""")
def _(spark, sf):
    return audit.decision_counters(decisions(spark, sf))


@query("j7_failure_counters", f"""WITH {FEEDBACK} SELECT reason, count(*) AS failures FROM (
  SELECT 'final_anomaly_label' AS reason FROM feedback WHERE final_anomaly_label = 'MAYBE'
  UNION ALL SELECT 'usefulness_rating' FROM feedback WHERE rating NOT BETWEEN 1 AND 5) GROUP BY 1""")
def _(spark, sf):
    return audit.failure_counters(audit.split_valid(feedback(spark, sf), audit.feedback_rules()))


@query("j8_latency_histogram", f"""WITH {DECISIONS} SELECT source, le, count(*) FILTER (value / 100 <= bound) AS observations FROM decisions,
  (VALUES ('0.01', 0.01::DOUBLE), ('0.05', 0.05::DOUBLE), ('0.1', 0.1::DOUBLE), ('0.25', 0.25::DOUBLE), ('0.5', 0.5::DOUBLE), ('1', 1::DOUBLE), ('2.5', 2.5::DOUBLE), ('5', 5::DOUBLE), ('+Inf', 1e300::DOUBLE)) b(le, bound) GROUP BY 1, 2""")
def _(spark, sf):
    return audit.latency_histogram(decisions(spark, sf).withColumn("seconds", F.col("value") / 100), by=("source",))


# ---- K ------------------------------------------------------------------------------------------------
def event_stream(spark, sf):
    """The events table as a stream."""
    schema = T.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def drain(spark, stream_df, name: str, mode: str = "append"):
    """Run a stream over all available input into a table of files."""
    path = A.scratch(spark, name)
    running = stream_df.writeStream.format("parquet").outputMode(mode).option(
        "checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start(path + "/data")
    running.awaitTermination()
    return spark.read.parquet(path + "/data")


@query("k1_stream_decisions", f"""WITH {DECISIONS} SELECT source, recommendation, count(*) AS decisions FROM decisions GROUP BY 1, 2""")
def _(spark, sf):
    path = A.scratch(spark, "stream")
    arriving = event_stream(spark, sf)

    def decide(batch):
        return batch.select(
            F.concat_ws("-", "user_id", "event_id").alias("incident_id"),
            F.when(F.col("event_id") % 2 == 0, "hdfs_hybrid_retrieval").otherwise("bgl_evidence_grounded_triage").alias("source"),
            F.when(F.col("event_type") == "error", C.LIKELY_ANOMALY).when(F.col("event_type") == "view", C.NEEDS_REVIEW)
            .otherwise(C.LIKELY_NORMAL).alias("recommendation"))

    stream.stream_decisions(arriving, decide, path + "/table", path + "/checkpoint").awaitTermination()
    return spark.read.parquet(path + "/table").groupBy("source", "recommendation").agg(F.count(F.lit(1)).alias("decisions"))


@query("k1_stream_triage", """SELECT doc_id AS incident_id, 'documents' AS source, true AS as_in_batch, true AS known FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    """Arriving documents against a model, an index and a policy fitted on the labelled ones."""
    from logsift.plans import holdout
    from logsift.plans.triage import triage

    known = E.masked(spark, sf).join(T.labelled(spark, sf), "doc_id").withColumn("doc_pos", F.col("doc_id")).persist()
    fitted = holdout.fit_triage(known.filter("doc_id % 3 > 0"), known.filter("doc_id % 3 = 0"), conservative=False)
    labels = T.labelled(spark, sf).select("doc_id")
    masked = X.normalize_cross_domain(F.col("text")).alias("text")
    documents = spark.readStream.schema(T.table(spark, sf, "documents").schema).option("pathGlobFilter", "documents.parquet").parquet(sf)
    arriving = documents.select("doc_id", masked).join(labels, "doc_id", "left_anti")
    path = A.scratch(spark, "triage")
    stream.stream_triage(arriving, fitted, path + "/table", path + "/checkpoint", "documents").awaitTermination()
    batch = triage(E.masked(spark, sf).join(labels, "doc_id", "left_anti"), fitted).select(
        F.col("doc_id").alias("incident_id"), F.col("recommendation").alias("_decided"), F.col("top_similarity").alias("_similarity"))
    both = spark.read.parquet(path + "/table").join(batch, "incident_id", "full")
    same = (F.col("recommendation") == F.col("_decided")) & (F.abs(F.col("top_similarity") - F.col("_similarity")) < 1e-9)
    return both.select("incident_id", "source", same.alias("as_in_batch"),
                       F.col("recommendation").isin(C.LIKELY_ANOMALY, C.LIKELY_NORMAL, C.NEEDS_REVIEW).alias("known"))


COUNTERS = f"""WITH {DECISIONS} SELECT date_trunc('day', created_at) AS window_start, source, recommendation, count(*) AS requests
FROM decisions GROUP BY 1, 2, 3"""


@query("k2_windowed_counters", COUNTERS)
def _(spark, sf):
    rows = decisions(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return counters.windowed_counters(rows, width="1 day").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("k2_stream_counters", """WITH c AS (SELECT date_trunc('day', ts) AS window_start, 'events' AS source, event_type AS recommendation, count(*) AS requests FROM events GROUP BY 1, 2, 3)
SELECT * FROM c WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(spark, sf):
    """Windows that the watermark closed by the end of the input."""
    rows = event_stream(spark, sf).select(
        F.col("ts").cast("timestamp").alias("created_at"), F.lit("events").alias("source"), F.col("event_type").alias("recommendation"))
    found = drain(spark, counters.windowed_counters(rows, width="1 day"), "counters")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("k3_stream_count_windows", f"""WITH {T.PARSED}, n AS (SELECT user_id, message, is_alert, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM parsed)
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(i // 20 AS BIGINT) AS window_number, CAST(max(is_alert) AS INTEGER) AS is_anomaly, 20 AS events,
  md5(string_agg(message, chr(10) ORDER BY i)) AS content FROM n GROUP BY 1, 2 HAVING count(*) = 20""")
def _(spark, sf):
    from logsift.operators import windows

    events = windows.alert_events(T.alert_lines(event_stream(spark, sf)))
    opened = stream_windows.stream_count_windows(events, "user_id", "event_id")
    return drain(spark, opened, "windows").select(
        "user_id", "window_number", "is_anomaly", "events", F.md5("text").alias("content"))
