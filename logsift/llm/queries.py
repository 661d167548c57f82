"""One query per operator with production parameters, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.llm import chat_format, language_id, license_scan, pieces, quality, url_rules
from logsift.llm.collocations import collocations
from logsift.llm.decontamination import contaminated
from logsift.llm.hard_negatives import hard_negatives
from logsift.llm.near_duplicates import near_duplicates
from logsift.llm.substring_dedup import substring_dedup
from logsift.llm.suffix_dedup import suffix_dedup
from logsift.llm.vantage_search import nearest

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_vantage_search", """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.e, b.e) AS score
  FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")
def _(spark, sf):
    return nearest(table(spark, sf, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@query("op2_decontamination")
def _(spark, sf):
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op3_license_scan")
def _(spark, sf):
    return license_scan.license_scan(table(spark, sf, "documents"))


@query("op4_quality_classifier")
def _(spark, sf):
    scored = quality.score_quality(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    return scored.select("doc_id", (~quality.may_learn(F.col("doc_id"))).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op5_url_filters", """
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + """),
fit AS (
  SELECT page_id, arg_max(struct_pack(rule := rule_host || rule_path, verdict := rule_verdict),
      length(rule_host || rule_path)) AS best
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit USING (page_id)""")
def _(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf, "pages"), rules)


_PROBE = "</s>[INST] ok [/INST]"


@query("op6_chat_format", f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}')),
m AS (
  SELECT *, row_number() OVER w > 1 AND lag(role) OVER w = role AS merged,
    length(replace(replace(replace(text, '\\', '\\\\'), '<', '<\\'), '[', '[\\')) AS text_chars,
    length(replace(replace(replace(role, '\\', '\\\\'), '<', '<\\'), '[', '[\\')) AS role_chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(text_chars + CASE WHEN merged THEN 7 ELSE role_chars + 13 END) AS BIGINT) AS formatted_chars
  FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars FROM g""")
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{_PROBE}' AS text")
    return chat_format.digests(chat_format.read_back(chat_format.format_chats(turns.unionByName(probe))))


@query("op7_suffix_array_dedup")
def _(spark, sf):
    return suffix_dedup(table(spark, sf, "documents"))


@query("op8_minhash_near_dedup")
def _(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))


@query("op9_substring_dedup")
def _(spark, sf):
    return substring_dedup(table(spark, sf, "documents"))


@query("op10_sentencepiece")
def _(spark, sf):
    return pieces.digests(pieces.encode_and_decode(table(spark, sf, "documents").select("doc_id", "text")))


@query("op11_hard_negatives", """
WITH e AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10""")
def _(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf, "embeddings"), lambda vec_id: vec_id % 100 == 0, label)


_BELOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op12_collocations", f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{_BELOW[0]}', '{_BELOW[1]}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM s),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (
  SELECT lang, phrase, a, l, r, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3)
  GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank,
  s.phrase, a, l, r, n, score
FROM scored s JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang) t ON t.lang = s.lang
LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
WHERE o.f IS NULL OR 100 * o.f < 50 * a
QUALIFY rank <= 2000""")
def _(spark, sf):
    return collocations(table(spark, sf, "documents").select("lang", "text"))


@query("op13_language_id")
def _(spark, sf):
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))
    found = language_id.identify_languages(table(spark, sf, "documents").select("doc_id", "text", "lang"), learn)
    return found.select("doc_id", (~learn).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
