"""The given tables seen as the engine's inputs, in Spark and in SQL side by side.

Each function reads a whole table; each ``*_SQL`` constant is the same relation in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logsift.sources.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- documents as incidents; their lines as events ------------------------------------
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))


LINES = """lines AS (
  SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS pos, unnest(parts) AS value
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label: 1 where quality is 0."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, 1).otherwise(0).alias("label"))


LABELLED = """labelled AS (
  SELECT doc_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS label FROM labels)"""


# ---- events as an alert log ----------------------------------------------------------
def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw alert-log lines, one per event, in (ts, event_id) order."""
    return alert_lines(table(spark, sf_dir, "events"))


def alert_lines(e: DataFrame) -> DataFrame:
    user = F.col("user_id")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    node = F.concat(
        F.lit("R"), two(user % 64), F.lit("-M"), (user % 2).cast("string"), F.lit("-N"),
        (user % 16).cast("string"), F.lit("-C:J"), two(user % 18), F.lit("-U"), two(user % 12))
    ip = F.concat(F.lit("/10."), (user % 256).cast("string"), F.lit("."),
                  (F.col("event_id") % 256).cast("string"), F.lit(".7"))
    line = F.concat_ws(
        " ",
        F.when(F.col("event_type") == "error", "KERNDTLB").otherwise("-"),
        F.date_format("ts", "yyyyMMddHHmmss"),
        F.date_format("ts", "yyyy.MM.dd"), node,
        F.date_format("ts", "yyyy-MM-dd-HH.mm.ss.SSSSSS"), node, F.lit("RAS KERNEL"),
        F.when(F.col("event_type") == "error", "FATAL").otherwise("INFO"),
        F.col("event_type"), F.lit("from"), F.concat(ip, F.lit(":50010")), F.lit("via"), ip,
        F.concat(F.lit("at 0x"), F.lower(F.hex("event_id"))), F.lit("session"),
        user.cast("string"), F.col("props"))
    return e.select("event_id", "ts", "user_id", line.alias("value"))


ALERT_LOG = """alert_log AS (
  SELECT event_id, ts, user_id,
    concat_ws(' ', CASE WHEN event_type = 'error' THEN 'KERNDTLB' ELSE '-' END,
      strftime(ts, '%Y%m%d%H%M%S'), strftime(ts, '%Y.%m.%d'), node,
      strftime(ts, '%Y-%m-%d-%H.%M.%S.%f'), node, 'RAS KERNEL',
      CASE WHEN event_type = 'error' THEN 'FATAL' ELSE 'INFO' END,
      event_type, 'from', ip || ':50010', 'via', ip, 'at 0x' || lower(to_hex(event_id)),
      'session', CAST(user_id AS VARCHAR), props) AS value
  FROM (SELECT *, 'R' || lpad(CAST(user_id % 64 AS VARCHAR), 2, '0') || '-M' || (user_id % 2)
          || '-N' || (user_id % 16) || '-C:J' || lpad(CAST(user_id % 18 AS VARCHAR), 2, '0')
          || '-U' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS node,
          '/10.' || (user_id % 256) || '.' || (event_id % 256) || '.7' AS ip
        FROM events))"""

PARSED = ALERT_LOG + r""", parsed AS (
  SELECT event_id, ts, user_id, value,
    CASE WHEN p[1] <> '' THEN p[1] || ' ' || p[2] ELSE 'unknown' END AS timestamp,
    'bluegene-l' AS service,
    CASE WHEN split_part(value, ' ', 1) <> '-' THEN 'ALERT' ELSE 'INFO' END AS severity,
    CASE WHEN p[1] <> '' THEN p[3] ELSE value END AS message,
    CASE WHEN split_part(value, ' ', 1) <> '-' THEN 1 ELSE 0 END AS is_alert
  FROM (SELECT *, [regexp_extract(value, '^(\S+)\s+(\S+)\s+(.*)$', 1),
                   regexp_extract(value, '^(\S+)\s+(\S+)\s+(.*)$', 2),
                   regexp_extract(value, '^(\S+)\s+(\S+)\s+(.*)$', 3)] AS p FROM alert_log))"""

NUMBERED = PARSED + """, numbered AS (
  SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM parsed),
windows AS (
  SELECT CAST(i // 20 AS BIGINT) AS window_number, max(is_alert) AS is_anomaly,
    string_agg(message, chr(10) ORDER BY i) AS text
  FROM numbered GROUP BY i // 20 HAVING count(*) = 20)"""


# ---- lineitem as a block log ----------------------------------------------------------
def block_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw block-log lines; the first line item of an order names its block twice."""
    li = table(spark, sf_dir, "lineitem")
    block = F.concat(F.lit("blk_"), F.when(F.col("l_orderkey") % 2 == 0, "-").otherwise(""),
                     F.col("l_orderkey").cast("string"))
    line = F.concat_ws(
        " ", F.date_format("l_shipdate", "yyMMdd"), F.lit("042720"),
        F.col("l_suppkey").cast("string"),
        F.when(F.col("l_returnflag") == "R", "WARN").otherwise("INFO"),
        F.lit("dfs.DataNode: Served block"), block,
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("copy of "), block)),
        F.lit("of size"), F.col("l_partkey").cast("string"), F.lit("to"),
        F.concat(F.lit("/10.251."), F.col("l_linenumber").cast("string"), F.lit("."),
                 (F.col("l_suppkey") % 256).cast("string")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                     line.alias("value"))


BLOCK_LOG = """block_log AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    concat_ws(' ', strftime(l_shipdate, '%y%m%d'), '042720', CAST(l_suppkey AS VARCHAR),
      CASE WHEN l_returnflag = 'R' THEN 'WARN' ELSE 'INFO' END, 'dfs.DataNode: Served block', b,
      CASE WHEN l_linenumber = 1 THEN 'copy of ' || b END, 'of size', CAST(l_partkey AS VARCHAR),
      'to', '/10.251.' || l_linenumber || '.' || (l_suppkey % 256)) AS value
  FROM (SELECT *, 'blk_' || CASE WHEN l_orderkey % 2 = 0 THEN '-' ELSE '' END || l_orderkey AS b
        FROM lineitem))"""


def block_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, label of the orders with a known state."""
    o = table(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderstatus") != "P").select(
        F.concat(F.lit("blk_"), F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise(""),
                 F.col("o_orderkey").cast("string")).alias("block_id"),
        F.when(F.col("o_orderstatus") == "F", "Anomaly").otherwise("Normal").alias("label"))


BLOCK_LABELS = """block_labels AS (
  SELECT 'blk_' || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || o_orderkey AS block_id,
    CASE WHEN o_orderstatus = 'F' THEN 'Anomaly' ELSE 'Normal' END AS label
  FROM orders WHERE o_orderstatus <> 'P')"""

KEYED = BLOCK_LOG + """, keyed AS (
  SELECT *, unnest(ids) AS block_id, CAST(unnest(range(len(ids))) AS INTEGER) AS mention
  FROM (SELECT *, regexp_extract_all(value, 'blk_-?\\d+') AS ids FROM block_log))""".replace("\\\\", "\\")


# ---- events as scored incidents ---------------------------------------------------------
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic probabilities and evidence for policy and metric operators.

    p leans on the label so that calibrations find admissible policies.
    """
    e = table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "error", 1).otherwise(0)
    noise = (F.col("event_id") * 37 % 1000) / F.lit(1000.0)
    clean = F.col("event_id") * 13 % 100 < 97
    guess = F.when(clean, label).otherwise(1 - label)
    vote = lambda m, r: F.when(F.col("event_id") * m % 100 < r, guess).otherwise(1 - guess)
    return e.select(
        "event_id", "ts", "user_id", label.alias("label"),
        (0.2 * noise + F.when(guess == 1, 0.6).otherwise(0.15)).alias("p"),
        (0.6 * noise + 0.2 * label).alias("other_p"),
        ((F.col("event_id") * 91 % 997) / F.lit(997.0)).alias("top_similarity"),
        guess.alias("evidence_label"),
        vote(7, 90).alias("second_label"), vote(11, 85).alias("third_label"),
    ).withColumn("unanimous", (F.col("evidence_label") == F.col("second_label"))
                 & (F.col("second_label") == F.col("third_label"))
    ).withColumn("anomaly_votes", F.col("evidence_label") + F.col("second_label") + F.col("third_label")
    ).withColumn("matches", F.lit(3))


SCORED = """scored AS (
  SELECT *, (evidence_label = second_label AND second_label = third_label) AS unanimous,
    evidence_label + second_label + third_label AS anomaly_votes, 3 AS matches
  FROM (SELECT event_id, ts, user_id, label, guess AS evidence_label,
      0.2::DOUBLE * noise + CASE WHEN guess = 1 THEN 0.6::DOUBLE ELSE 0.15::DOUBLE END AS p,
      0.6::DOUBLE * noise + 0.2::DOUBLE * label AS other_p,
      (event_id * 91 % 997) / 997.0::DOUBLE AS top_similarity,
      CASE WHEN event_id * 7 % 100 < 90 THEN guess ELSE 1 - guess END AS second_label,
      CASE WHEN event_id * 11 % 100 < 85 THEN guess ELSE 1 - guess END AS third_label
    FROM (SELECT *, CASE WHEN event_id * 13 % 100 < 97 THEN label ELSE 1 - label END AS guess,
        (event_id * 37 % 1000) / 1000.0::DOUBLE AS noise
      FROM (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events))))"""

ASSESSED = SCORED + """, assessed AS (
  SELECT *, CASE WHEN prediction = 1 THEN p ELSE 1.0::DOUBLE - p END AS confidence,
    evidence_label = prediction AS agrees,
    CASE WHEN prediction <> label THEN 1 ELSE 0 END AS wrong
  FROM (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored))"""


# ---- embeddings in chronological parts -----------------------------------------------------
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
