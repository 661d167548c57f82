"""Sources, scalar operators, windows, sampling and splits."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from checks import sql as Q, tables as T
from logsift import schemas as S
from logsift.functions import text as X
from logsift.operators import audit, investigation, sampling, splits, windows
from logsift.session import shared_folder
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


def scratch(spark, name: str) -> str:
    """A folder for files a query writes and reads back, on the cluster's shared storage."""
    return f"{shared_folder(spark)}/{name}-{os.urandom(4).hex()}"


# ---- A -----------------------------------------------------------------------------------
def _documents_as_incidents(spark, sf):
    docs = T.documents(spark, sf).join(T.labelled(spark, sf), "doc_id", "left")
    empty = F.lit("")
    events = F.transform(F.split("text", "\n"), lambda m: F.struct(
        empty.alias("timestamp"), F.col("source").alias("service"),
        empty.alias("severity"), m.alias("message")))
    return docs.select(
        F.col("doc_id").cast("string").alias("incident_id"),
        F.coalesce("label", F.lit(0)).alias("is_anomaly"),
        F.lit("unknown").alias("root_cause"), "source", events.alias("events"))


@query("a1_read_incidents", f"""WITH {T.LABELLED}
SELECT CAST(doc_id AS VARCHAR) AS incident_id, coalesce(label, 0) AS is_anomaly,
  CAST(len(string_split(text, chr(10))) AS INTEGER) AS events, md5(text) AS content
FROM documents LEFT JOIN labelled USING (doc_id)""")
def _(spark, sf):
    path = scratch(spark, "incidents")
    writers.write_incidents(_documents_as_incidents(spark, sf), path + "/data")
    return readers.read_incidents(spark, path + "/data").select(
        "incident_id", "is_anomaly", F.size("events").alias("events"),
        F.md5(F.array_join(F.col("events.message"), "\n")).alias("content"))


@query("a2_read_log_lines", f"""WITH {T.LINES}
SELECT {Q.strip('value')} AS value, count(*) AS lines FROM lines
WHERE {Q.strip('value')} <> '' GROUP BY 1""")
def _(spark, sf):
    path = scratch(spark, "lines") + "/data"
    T.documents(spark, sf).select("text").write.text(path)
    return readers.read_log_lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("lines"))


@query("a3_read_labels", f"""WITH {T.BLOCK_LABELS}
SELECT block_id, label, CASE WHEN label = 'Anomaly' THEN 1 ELSE 0 END AS is_anomaly FROM block_labels""")
def _(spark, sf):
    path = scratch(spark, "labels") + "/data"
    T.block_labels(spark, sf).select(
        F.col("block_id").alias("BlockId"), F.col("label").alias("Label")
    ).write.option("header", True).csv(path)
    return readers.read_labels(spark, path)


def _traces(spark, sf):
    o = T.table(spark, sf, "orders")
    number = lambda m: ((F.col("o_orderkey") * m + F.col("o_custkey")) % 29 + 1).cast("string")
    steps = F.array(*[F.concat(F.lit("E"), number(m)) for m in (3, 5, 7, 11, 13)])
    return o.select(
        F.col("o_orderkey").cast("string").alias("BlockId"),
        F.when(F.col("o_orderstatus") == "F", "Fail").when(F.col("o_orderstatus") == "O", "Success")
        .otherwise("Open").alias("Label"),
        F.array_join(F.slice(steps, F.lit(1), (F.col("o_orderkey") % 6).cast("int")), ",").alias("Features"))


TRACES = """traces AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS block_id,
    CASE o_orderstatus WHEN 'F' THEN 'Fail' WHEN 'O' THEN 'Success' ELSE 'Open' END AS label,
    list_transform(list_slice([3, 5, 7, 11, 13], 1, o_orderkey % 6),
      lambda m: (o_orderkey * m + o_custkey) % 29 + 1) AS steps
  FROM orders)"""


@query("a4_read_event_traces", f"""WITH {TRACES}
SELECT block_id, CASE WHEN label = 'Fail' THEN 1 ELSE 0 END AS label,
  array_to_string(steps, ',') AS sequence
FROM traces WHERE label IN ('Success', 'Fail') AND len(steps) > 0""")
def _(spark, sf):
    path = scratch(spark, "traces") + "/data"
    _traces(spark, sf).write.option("header", True).csv(path)
    return readers.read_event_traces(spark, path).withColumn("sequence", F.array_join("sequence", ","))


@query("a5_write_incidents", f"""WITH {T.LABELLED}
SELECT CAST(coalesce(label, 0) AS INTEGER) AS is_anomaly, count(*) AS rows
FROM documents LEFT JOIN labelled USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    path = scratch(spark, "classes") + "/data"
    writers.write_incidents(_documents_as_incidents(spark, sf), path, "parquet")
    return splits.class_counts(spark.read.parquet(path), "is_anomaly")


@query("a6_read_json_array", """SELECT CAST(o_orderkey AS VARCHAR) AS id,
  'svc-' || o_custkey AS service, o_orderpriority AS summary FROM orders""")
def _(spark, sf):
    path = scratch(spark, "arrays") + "/data"
    o = T.table(spark, sf, "orders")
    record = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("svc-"), F.col("o_custkey").cast("string")).alias("service"),
        F.lit("").alias("commit"), F.col("o_orderdate").cast("string").alias("timestamp"),
        F.col("o_orderpriority").alias("summary"))
    # an array file holds the orders of one thousand consecutive keys
    o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("chunk")).agg(
        F.to_json(F.collect_list(record)).alias("value")
    ).write.partitionBy("chunk").text(path)
    return readers.read_json_array(spark, path, S.DEPLOYMENT).select("id", "service", "summary")


# ---- B -----------------------------------------------------------------------------------
@query("b1_parse_alert_line", f"""WITH {T.PARSED}
SELECT event_id, timestamp, service, severity, message, is_alert FROM parsed""")
def _(spark, sf):
    return windows.alert_events(T.alert_log(spark, sf)).drop("ts", "user_id")


@query("b2_extract_keys", f"""WITH {T.KEYED}
SELECT block_id, mention, value FROM keyed""")
def _(spark, sf):
    return windows.keyed_lines(T.block_log(spark, sf)).select("block_id", "mention", "value")


@query("b3_label_lines", f"""WITH {T.KEYED}, {T.BLOCK_LABELS}
SELECT k.block_id, coalesce(b.label, 'Unknown') AS label, count(*) AS lines
FROM keyed k LEFT JOIN block_labels b ON k.block_id = b.block_id GROUP BY 1, 2""")
def _(spark, sf):
    labelled = windows.label_lines(windows.keyed_lines(T.block_log(spark, sf)), T.block_labels(spark, sf))
    return labelled.groupBy("block_id", "label").agg(F.count(F.lit(1)).alias("lines"))


@query("b4_normalize_single_domain", f"""WITH {T.BLOCK_LOG}
SELECT {Q.single_domain('value')} AS template, count(*) AS lines FROM block_log GROUP BY 1""")
def _(spark, sf):
    masked = T.block_log(spark, sf).select(X.normalize_single_domain(F.col("value")).alias("template"))
    return masked.groupBy("template").agg(F.count(F.lit(1)).alias("lines"))


@query("b5_normalize_cross_domain", f"""WITH {T.ALERT_LOG}, {T.LINES}
SELECT {Q.cross_domain('value')} AS template, count(*) AS lines
FROM (SELECT value FROM alert_log UNION ALL SELECT value FROM lines) GROUP BY 1""")
def _(spark, sf):
    raw = T.alert_log(spark, sf).select("value").unionByName(T.lines(spark, sf).select("value"))
    masked = raw.select(X.normalize_cross_domain(F.col("value")).alias("template"))
    return masked.groupBy("template").agg(F.count(F.lit(1)).alias("lines"))


@query("b6_incident_text", rf"""WITH {T.LINES}
SELECT doc_id,
  md5(string_agg(value, ' ' ORDER BY pos)) AS raw_space,
  md5(lower(string_agg(value, ' ' ORDER BY pos))) AS lower_space,
  md5(coalesce(string_agg(value, chr(10) ORDER BY pos) FILTER (value <> ''), '')) AS raw_newline,
  md5(coalesce(string_agg({Q.single_domain('value')}, chr(10) ORDER BY pos) FILTER (value <> ''), '')) AS normalized_newline,
  md5(coalesce(string_agg({Q.cross_domain('value')}, chr(10) ORDER BY pos) FILTER (value <> ''), '')) AS cross_domain_newline
FROM lines GROUP BY doc_id""")
def _(spark, sf):
    events = F.transform(F.split("text", "\n"), lambda m: F.struct(m.alias("message")))
    docs = T.documents(spark, sf).select("doc_id", events.alias("events"))
    modes = ("raw_space", "lower_space", "raw_newline", "normalized_newline", "cross_domain_newline")
    return docs.select("doc_id", *[F.md5(X.incident_text(F.col("events"), m)).alias(m) for m in modes])


def _knowledge(spark, sf):
    """benchmark items as knowledge: alternate incidents and runbooks."""
    b = T.table(spark, sf, "benchmark")
    words = F.split("text", " ")
    item = F.col("item_id")
    return b.select(
        F.concat(F.lit("KB-"), item.cast("string")).alias("id"), item.alias("doc_pos"),
        F.when(item % 2 == 0, "incident").otherwise("runbook").alias("kind"),
        F.array_join(F.slice(words, 1, 6), " ").alias("title"),
        F.concat(F.lit("svc-"), (item % 7).cast("string")).alias("service"),
        F.array(F.array_join(F.slice(words, 7, 8), " "), F.lit(""), F.array_join(F.slice(words, 15, 8), " ")).alias("symptoms"),
        F.when(item % 2 == 0, F.concat(F.lit("cause-"), (item % 10).cast("string"))).alias("root_cause"),
        F.array_join(F.slice(words, F.lit(23), F.greatest(F.size(words), F.lit(1))), " ").alias("resolution"),
        F.array(F.concat(F.lit("check "), F.element_at(words, 1)), F.lit("compare metrics"),
                F.concat(F.lit("inspect "), F.element_at(words, 2))).alias("steps"),
        F.slice(words, 3, 3).alias("tags"))


KNOWLEDGE = """knowledge AS (
  SELECT 'KB-' || item_id AS id, item_id AS doc_pos,
    CASE WHEN item_id % 2 = 0 THEN 'incident' ELSE 'runbook' END AS kind,
    array_to_string(words[1:6], ' ') AS title, 'svc-' || (item_id % 7) AS service,
    [array_to_string(words[7:14], ' '), '', array_to_string(words[15:22], ' ')] AS symptoms,
    CASE WHEN item_id % 2 = 0 THEN 'cause-' || (item_id % 10) END AS root_cause,
    array_to_string(words[23:], ' ') AS resolution,
    ['check ' || words[1], 'compare metrics', 'inspect ' || words[2]] AS steps, words[3:5] AS tags
  FROM (SELECT item_id, string_split(text, ' ') AS words FROM benchmark)),
knowledge_text AS (
  SELECT *, lower(array_to_string(list_filter(
    list_concat([title, service, resolution], symptoms, tags), lambda x: x <> ''), ' ')) AS text
  FROM knowledge)"""


@query("b7_knowledge_text", f"WITH {KNOWLEDGE} SELECT id, text FROM knowledge_text")
def _(spark, sf):
    return _knowledge(spark, sf).select("id", X.knowledge_text(
        *[F.col(c) for c in ("title", "service", "resolution", "symptoms", "tags")]).alias("text"))


@query("b8_is_error_message", f"""WITH {T.ALERT_LOG}
SELECT event_id, CASE WHEN regexp_matches(value, '(?i)error|fatal|exception|timeout|failed|refused')
  THEN 1 ELSE 0 END AS is_error FROM alert_log""")
def _(spark, sf):
    return T.alert_log(spark, sf).select(
        "event_id", X.is_error_message(F.col("value")).cast("int").alias("is_error"))


@query("b9_error_template", rf"""WITH {T.ALERT_LOG}
SELECT regexp_replace(lower(value), '\d+', '<num>', 'g') AS template, count(*) AS lines
FROM alert_log GROUP BY 1""")
def _(spark, sf):
    return T.alert_log(spark, sf).groupBy(X.error_template(F.col("value")).alias("template")).agg(
        F.count(F.lit(1)).alias("lines"))


@query("b10_meaningful_tokens", f"""WITH {T.LINES}
SELECT doc_id, pos, array_to_string(list_sort({Q.evidence_tokens('value')}), ' ') AS tokens FROM lines""")
def _(spark, sf):
    return T.lines(spark, sf).select("doc_id", "pos", F.array_join(
        F.sort_array(X.meaningful_tokens(F.col("value"))), " ").alias("tokens"))


@query("b11_unique_strings", f"""WITH {T.LINES}, firsts AS (
  SELECT doc_id, {Q.strip('value')} AS v, min(pos) AS pos FROM lines GROUP BY 1, 2)
SELECT d.doc_id, md5(coalesce(u.joined, '')) AS content FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(v, '|' ORDER BY pos) AS joined FROM firsts WHERE v <> '' GROUP BY doc_id) u
  USING (doc_id)""")
def _(spark, sf):
    return T.documents(spark, sf).select("doc_id", F.md5(F.array_join(
        X.unique_strings(F.split("text", "\n")), "|")).alias("content"))


@query("b12_order_key", rf"""WITH {T.BLOCK_LOG}, {T.NUMBERED}
SELECT regexp_extract(value, '^(\d{{6}})\s+(\d{{6}})\b', 1)
    || regexp_extract(value, '^(\d{{6}})\s+(\d{{6}})\b', 2) AS order_key, count(*) AS rows
FROM block_log GROUP BY 1
UNION ALL SELECT CAST(window_number AS VARCHAR), 1 FROM windows""")
def _(spark, sf):
    block = T.block_log(spark, sf).select(X.block_order_key(F.array("value")).alias("order_key"))
    window = windows.count_windows(
        windows.alert_events(T.alert_log(spark, sf)), F.col("ts"), F.col("event_id"))
    number = window.select(X.window_order_key(F.col("incident_id")).cast("string").alias("order_key"),
                           F.lit(1).cast("bigint").alias("rows"))
    return block.groupBy("order_key").agg(F.count(F.lit(1)).alias("rows")).unionByName(number)


@query("b13_event_id_sequence", f"""WITH {TRACES}
SELECT block_id, array_to_string(list_transform(range(1, 5), lambda i: coalesce(steps[i], 0)), ',') AS padded,
  (SELECT max(m) + 1 FROM (SELECT list_max(steps) AS m FROM traces WHERE label <> 'Open')) AS vocabulary
FROM traces WHERE label <> 'Open' AND len(steps) > 0""")
def _(spark, sf):
    traces = readers.event_traces(_traces(spark, sf))
    size = traces.agg((F.max(F.array_max("sequence")) + 1).cast("bigint").alias("vocabulary"))
    return traces.select("block_id", F.array_join(
        X.padded_sequence(F.col("sequence"), 4), ",").alias("padded")).join(F.broadcast(size))


@query("b14_validate_requests", f"""WITH {T.LABELLED}, r AS (
  SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'x' WHEN doc_id % 9 = 1 THEN 'Org_' || doc_id ELSE 'org-' || lang END AS org,
    CASE WHEN doc_id % 5 = 0 THEN 'LIKELY_NORMAL' ELSE 'LIKELY_ANOMALY' END AS rec,
    string_split(text, chr(10)) AS msgs FROM documents)
SELECT doc_id, concat_ws(',',
  CASE WHEN len(msgs) > 500 THEN 'events' END,
  CASE WHEN len(list_filter(msgs, lambda m: length(m) < 1 OR length(m) > 4000)) > 0 THEN 'message' END,
  CASE WHEN NOT (length(org) BETWEEN 2 AND 100 AND regexp_matches(org, '^[a-z0-9][a-z0-9-]*$')) THEN 'organization_id' END,
  CASE WHEN rec NOT IN ('LIKELY_ANOMALY', 'NEEDS_HUMAN_REVIEW') THEN 'triage_recommendation' END) AS failed
FROM r""")
def _(spark, sf):
    number = F.col("doc_id")
    requests = T.documents(spark, sf).select(
        "doc_id", number.cast("string").alias("incident_id"),
        F.when(number % 9 == 0, "x").when(number % 9 == 1, F.concat(F.lit("Org_"), number.cast("string")))
        .otherwise(F.concat(F.lit("org-"), F.col("lang"))).alias("organization_id"),
        F.when(number % 5 == 0, "LIKELY_NORMAL").otherwise("LIKELY_ANOMALY").alias("triage_recommendation"),
        F.transform(F.split("text", "\n"), lambda m: F.struct(m.alias("message"))).alias("events"))
    checked = audit.split_valid(requests, audit.investigation_rules())
    return checked.select("doc_id", F.array_join("failed", ",").alias("failed"))


@query("b15_approved_fields", f"""WITH {KNOWLEDGE}
SELECT id, kind, title, service, array_to_string(list_filter(list_distinct_kept, lambda s: s <> ''), '|') AS symptoms
FROM (SELECT *, list_transform(symptoms, lambda s: trim(s)) AS list_distinct_kept FROM knowledge)""")
def _(spark, sf):
    return investigation.approved_fields(_knowledge(spark, sf)).select(
        "id", "kind", "title", "service", F.array_join("symptoms", "|").alias("symptoms"))


@query("b16_incident_listing", f"""WITH {T.LABELLED}
SELECT CAST(doc_id AS VARCHAR) AS incident_id, coalesce(label, 0) AS is_anomaly, 'unknown' AS root_cause
FROM documents LEFT JOIN labelled USING (doc_id)""")
def _(spark, sf):
    return audit.incident_listing(_documents_as_incidents(spark, sf))


@query("b17_lookup_incident", "SELECT event_id AS incident_id, event_type FROM events WHERE event_id = 42")
def _(spark, sf):
    events = T.table(spark, sf, "events").select(F.col("event_id").alias("incident_id"), "event_type")
    return audit.lookup_incident(events, 42)


# ---- C -----------------------------------------------------------------------------------
def alert_windows(spark, sf):
    return windows.count_windows(
        windows.alert_events(T.alert_log(spark, sf)), F.col("ts"), F.col("event_id"))


@query("c1_count_windows", f"""WITH {T.NUMBERED}
SELECT 'bgl-window-' || lpad(CAST(window_number AS VARCHAR), 6, '0') AS incident_id,
  CAST(is_anomaly AS INTEGER) AS is_anomaly, 20 AS events, md5(text) AS content FROM windows""")
def _(spark, sf):
    return alert_windows(spark, sf).select(
        "incident_id", "is_anomaly", F.size("events").alias("events"),
        F.md5(X.incident_text(F.col("events"), "raw_newline")).alias("content"))


def log_files(spark, sf, name: str) -> str:
    """The alert log as several files whose names sort as its lines do, with blank lines between."""
    path = scratch(spark, name) + "/data"
    log = T.alert_log(spark, sf).repartitionByRange(5, "ts", "event_id").sortWithinPartitions("ts", "event_id")
    log.select(F.concat(F.col("value"), F.when(F.col("event_id") % 9 == 0, "\n  ").otherwise("")).alias("value")).write.text(path)
    return path


@query("a2_numbered_log_lines", f"""WITH {T.ALERT_LOG}
SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS line, md5(value) AS content FROM alert_log""")
def _(spark, sf):
    return readers.numbered_log_lines(spark, log_files(spark, sf, "numbered")).select("line", F.md5("value").alias("content"))


@query("c1_file_windows", f"""WITH {T.NUMBERED}
SELECT 'bgl-window-' || lpad(CAST(window_number AS VARCHAR), 6, '0') AS incident_id,
  CAST(is_anomaly AS INTEGER) AS is_anomaly, 20 AS events, md5(text) AS content FROM windows""")
def _(spark, sf):
    lines = readers.numbered_log_lines(spark, log_files(spark, sf, "file-windows"))
    opened = windows.count_windows(windows.alert_events(lines), number="line")
    return opened.select("incident_id", "is_anomaly", F.size("events").alias("events"),
                         F.md5(X.incident_text(F.col("events"), "raw_newline")).alias("content"))


@query("c2_sliding_count_windows", f"""WITH {T.ALERT_LOG}, placed AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY user_id) AS n FROM alert_log),
opened AS (SELECT *, unnest(range(greatest(0, (pos - 5) // 5), pos // 5 + 1)) AS w FROM placed)
SELECT user_id, CAST(w AS BIGINT) AS window_number, count(*) AS lines,
  md5(string_agg(value, chr(10) ORDER BY pos)) AS content
FROM opened WHERE pos >= w * 5 AND pos < w * 5 + 10 AND w * 5 + 10 <= n GROUP BY 1, 2""")
def _(spark, sf):
    opened = windows.sliding_count_windows(
        T.alert_log(spark, sf), "user_id", F.col("ts"), F.col("event_id"))
    # a window holds ten lines
    return opened.groupBy("user_id", F.col("window_number").cast("bigint").alias("window_number")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.md5(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("place", "value"))), lambda p: p["value"]), "\n")).alias("content"))


@query("c3_group_by_key", f"""WITH {T.KEYED}, {T.BLOCK_LABELS}
SELECT k.block_id, label, row_number() OVER (PARTITION BY k.block_id
    ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, value, mention) - 1 AS pos, value
FROM keyed k JOIN block_labels b ON k.block_id = b.block_id""")
def _(spark, sf):
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "value", "mention")]
    grouped = windows.group_by_key(
        windows.keyed_lines(T.block_log(spark, sf)), T.block_labels(spark, sf), *order)
    return grouped.select("block_id", "label", "pos", "value")


SAMPLE_SQL = """WITH drawn AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_anomaly,
    row_number() OVER (PARTITION BY event_type = 'error' ORDER BY md5('7:' || event_id), event_id) AS r FROM events)
SELECT event_id, is_anomaly FROM drawn WHERE r <= {n}"""


def labelled_events(spark, sf):
    return T.table(spark, sf, "events").select(
        "event_id", "ts", "event_type",
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_anomaly"))


@query("c4_sample_per_class", SAMPLE_SQL.format(n=5000))
def _(spark, sf):
    return sampling.sample_per_class(labelled_events(spark, sf), 5000, 7, "event_id").select("event_id", "is_anomaly")


@query("c5_sample_exact", SAMPLE_SQL.format(n=100))
def _(spark, sf):
    return sampling.sample_exact(labelled_events(spark, sf), 100, 7, "event_id").select("event_id", "is_anomaly")


@query("c6_balanced_support", SAMPLE_SQL.format(n=150))
def _(spark, sf):
    return sampling.balanced_support(labelled_events(spark, sf), 300, 7, "event_id").select("event_id", "is_anomaly")


POSITION_SQL = """positions AS (
  SELECT event_id, ts, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)"""


@query("c7_chronological_split", f"""WITH {POSITION_SQL}
SELECT event_id, CASE WHEN pos < floor(n * 0.6::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.8::DOUBLE) THEN 'validation'
  ELSE 'test' END AS split FROM positions""")
def _(spark, sf):
    return splits.chronological_split(labelled_events(spark, sf), ["ts", "event_id"]).select("event_id", "split")


@query("c8_locked_holdout", f"""WITH {T.NUMBERED}
SELECT window_number, CASE WHEN window_number < floor((SELECT count(*) FROM windows) * 0.8::DOUBLE)
  THEN 'development' ELSE 'locked' END AS period FROM windows""")
def _(spark, sf):
    split = splits.locked_holdout(alert_windows(spark, sf))
    splits.assert_later(split.filter("period = 'development'"), split.filter("period = 'locked'"), "window_number")
    return split.select("window_number", "period")


@query("c9_expanding_folds", f"""WITH {POSITION_SQL}, f(fold, s, v, e) AS (VALUES
  ('fold_1', 0.40::DOUBLE, 0.60::DOUBLE, 0.70::DOUBLE), ('fold_2', 0.50::DOUBLE, 0.70::DOUBLE, 0.80::DOUBLE),
  ('fold_3', 0.60::DOUBLE, 0.80::DOUBLE, 1.00::DOUBLE))
SELECT event_id, fold, CASE WHEN pos < floor(n * s) THEN 'support' WHEN pos < floor(n * v) THEN 'validation'
  ELSE 'evaluation' END AS role FROM positions, f WHERE pos < floor(n * e)""")
def _(spark, sf):
    return splits.expanding_folds(labelled_events(spark, sf), ["ts", "event_id"]).select("event_id", "fold", "role")


@query("c10_stratified_split", """WITH drawn AS (
  SELECT event_id, row_number() OVER (PARTITION BY event_type = 'error' ORDER BY md5('7:' || event_id), event_id) - 1 AS r,
    count(*) OVER (PARTITION BY event_type = 'error') AS n FROM events)
SELECT event_id, CASE WHEN r < floor(n * 0.6::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) THEN 'validation'
  ELSE 'test' END AS split FROM drawn""")
def _(spark, sf):
    return splits.stratified_split(
        labelled_events(spark, sf), (0.6, 0.8), ("train", "validation", "test"), 7, "event_id"
    ).select("event_id", "split")


@query("c11_ordered_split", f"""WITH {POSITION_SQL}
SELECT event_id, CASE WHEN pos < floor(n * 0.75::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM positions""")
def _(spark, sf):
    return splits.ordered_split(
        labelled_events(spark, sf), ["ts", "event_id"], 0.75, "is_anomaly").select("event_id", "split")


@query("c12_class_counts", f"""WITH {POSITION_SQL}
SELECT CASE WHEN pos < floor(n * 0.6::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.8::DOUBLE) THEN 'validation'
  ELSE 'test' END AS split, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_anomaly, count(*) AS rows
FROM positions GROUP BY 1, 2""")
def _(spark, sf):
    split = splits.chronological_split(labelled_events(spark, sf), ["ts", "event_id"])
    return splits.class_counts(split, "split", "is_anomaly")
