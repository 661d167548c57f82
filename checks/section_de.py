"""Features and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import section_abc as A, sql as Q, tables as T
from logsift import constants as C
from logsift.functions import text as X, vectors as V
from logsift.operators import cells, features as D, investigation as I, retrieval as R, splits

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def masked(spark, sf):
    return T.documents(spark, sf).select(
        "doc_id", X.normalize_cross_domain(F.col("text")).alias("text"))


MASKED = f"masked AS (SELECT doc_id, {Q.cross_domain('text')} AS text FROM documents)"
INDEXED = f"""{T.LABELLED}, {MASKED},
indexed AS (SELECT doc_id, text, label FROM masked JOIN labelled USING (doc_id)),
asked AS (SELECT doc_id, text FROM masked WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""


@query("d1_ngrams", f"""WITH {MASKED}
SELECT term, count(*) AS uses FROM (
  SELECT unnest({Q.grams('toks')}) AS term FROM (SELECT {Q.tokens('text')} AS toks FROM masked))
GROUP BY 1""")
def _(spark, sf):
    grams = D.term_arrays(masked(spark, sf), D.RETRIEVAL, ["doc_id"])
    return grams.select(F.explode_outer("_grams").alias("term")).filter(
        F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("uses"))


VOCABULARY_SQL = f"""WITH {MASKED}, counted AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest({Q.grams('toks')}) AS term FROM (SELECT doc_id, {Q.tokens('text', True)} AS toks FROM masked))
  GROUP BY 1, 2)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total,
  round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0, 6) AS idf
FROM counted GROUP BY term HAVING count(*) >= 2"""


@query("d2_fit_vocabulary", VOCABULARY_SQL + " ORDER BY total DESC, term LIMIT 5000")
def _(spark, sf):
    v = D.fit_vocabulary(masked(spark, sf), D.FOREST)
    return v.terms.select("term", "df", "total", F.round("idf", 6).alias("idf"))


@query("d3_tfidf", f"""WITH {MASKED}, {Q.tfidf('t', 'masked', 'masked', min_df=2)}
SELECT doc_id, count(*) AS terms, round(sum(w), 6) AS weight, round(max(w), 6) AS heaviest FROM t GROUP BY 1""")
def _(spark, sf):
    docs = masked(spark, sf)
    counts = D.term_counts(docs, D.RETRIEVAL, ["doc_id"]).persist()
    terms = D.tfidf_terms(docs, D.vocabulary_from_counts(counts, docs, D.RETRIEVAL), counts=counts)
    return terms.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("weight"),
        F.round(F.max("weight"), 6).alias("heaviest"))


@query("d4_to_sparse", f"""WITH {MASKED}, {Q.tfidf('t', 'masked', 'masked', min_df=2, lower=True, sublinear=False)},
top AS (SELECT term FROM t_fit GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 5000),
w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM t_raw WHERE term IN (SELECT term FROM top))
SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS entries, round(sum(w), 4) AS weight FROM w""")
def _(spark, sf):
    from pyspark.ml.stat import Summarizer

    docs = masked(spark, sf)
    v, size = D.numbered_vocabulary(D.fit_vocabulary(docs, D.FOREST))
    vectors = D.jvm_features(docs, v, size)
    from pyspark.ml.functions import vector_to_array

    stats = vectors.select(Summarizer.metrics("count", "numNonZeros", "sum").summary(F.col("features")).alias("s"))
    add = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x)
    return stats.select(F.col("s.count").alias("documents"), add(F.col("s.numNonZeros")).cast("bigint").alias("entries"),
                        F.round(add(F.col("s.sum")), 4).alias("weight"))


@query("d5_class_weights", f"""WITH {T.LABELLED}
SELECT doc_id, label, round((SELECT count(*) FROM labelled) / (2.0 * count(*) OVER (PARTITION BY label)), 6) AS weight
FROM labelled""")
def _(spark, sf):
    return D.class_weights(T.labelled(spark, sf)).select("doc_id", "label", F.round("weight", 6).alias("weight"))


@query("d6_domain_weights", """SELECT doc_id, round(0.5 / count(*) OVER (PARTITION BY lang = 'en')
  * (SELECT count(*) FROM documents), 6) AS domain_weight FROM documents""")
def _(spark, sf):
    docs = T.documents(spark, sf).withColumn("domain", F.when(F.col("lang") == "en", "source").otherwise("target"))
    return D.domain_weights(docs).select("doc_id", F.round("domain_weight", 6).alias("domain_weight"))


@query("d7_unit_vectors", """WITH n AS (SELECT vec_id, embedding,
    sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / l)), 6) AS total,
  round(embedding[1]::DOUBLE / l, 6) AS first FROM n""")
def _(spark, sf):
    unit = T.vectors(spark, sf).select("vec_id", V.unit_vector(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                       F.round(F.element_at("u", 1), 6).alias("first"))


@query("d8_stop_word_filter", f"""WITH {MASKED}
SELECT doc_id, CAST(len(list_filter({Q.tokens('text')}, lambda t: NOT list_contains(
  [{', '.join(repr(w) for w in C.ENGLISH_STOP_WORDS)}], t))) AS INTEGER) AS tokens FROM masked""")
def _(spark, sf):
    return masked(spark, sf).select("doc_id", F.size(X.without_words(
        X.feature_tokens(F.col("text")), C.ENGLISH_STOP_WORDS)).alias("tokens"))


TENANT = "CASE {0} % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END"  # a third has no organization


def tenant(column: str):
    return F.expr(TENANT.format(column))


# ---- E: lexical search of labelled documents -------------------------------------------------
def document_search(spark, sf, k=C.TOP_K):
    """Top-k labelled documents of every unlabelled one; columns query_id, rank, doc_id, score, label."""
    # masked once: sizes, vocabulary, copies and queries all read it
    docs, labels = masked(spark, sf).persist(), T.labelled(spark, sf)
    known = docs.join(labels, "doc_id").withColumn("doc_pos", F.col("doc_id"))
    asked = docs.join(labels, "doc_id", "left_anti").withColumnRenamed("doc_id", "query_id")
    index = R.build_index(known, k=k)
    return R.with_documents(R.search_batch(asked, index, k), index, "label"), known, asked


LEXICAL = f"""{INDEXED},
{Q.tfidf('tv', '(SELECT doc_id, text FROM masked)', 'indexed', min_df=2)},
pair_scores AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(q.w * d.w) AS score
  FROM tv q JOIN tv d ON q.term = d.term
  WHERE q.doc_id IN (SELECT doc_id FROM asked) AND d.doc_id IN (SELECT doc_id FROM indexed)
  GROUP BY 1, 2),
all_scores AS (
  SELECT a.doc_id AS query_id, i.doc_id, i.label, coalesce(s.score, 0.0) AS score
  FROM asked a CROSS JOIN indexed i LEFT JOIN pair_scores s ON s.query_id = a.doc_id AND s.doc_id = i.doc_id),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) AS rank FROM all_scores) WHERE rank <= 3)"""
VOTES = LEXICAL + """, votes AS (
  SELECT query_id, max(score) FILTER (rank = 1) AS top_similarity, max(label) FILTER (rank = 1) AS evidence_label,
    min(label) = max(label) AS unanimous, CAST(sum(label) AS BIGINT) AS anomaly_votes, count(*) AS matches
  FROM ranked GROUP BY 1)"""


@query("e1_lexical_scores", f"""WITH {LEXICAL}
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked""")
def _(spark, sf):
    found, _, _ = document_search(spark, sf)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


VECTOR_PARTS = """v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS pos,
    count(*) OVER () AS n, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l
  FROM embeddings),
u AS (SELECT vec_id, label, pos < floor(n * 0.6::DOUBLE) AS old,
    list_transform(embedding, lambda x: x::DOUBLE / l) AS e FROM v)"""


def vector_parts(spark, sf):
    """The first 60% of the vectors as index, the later ones as queries."""
    split = splits.chronological_split(T.vectors(spark, sf), ["vec_id"])
    unit = split.withColumn("embedding", V.unit_vector(F.col("embedding")))
    old = unit.filter("split = 'train'").select(
        F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("doc_pos"), "label", "embedding")
    late = unit.filter("split <> 'train'").select(F.col("vec_id").alias("query_id"), "label", "embedding", "split")
    return old, late


@query("e2_semantic_scores", f"""WITH {VECTOR_PARTS}, s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.e, d.e) AS score
  FROM u q, u d WHERE NOT q.old AND d.old)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) AS rank FROM s) WHERE rank <= 3""")
def _(spark, sf):
    old, late = vector_parts(spark, sf)
    index = R.build_index(old, None)
    return R.search_batch(late.select("query_id", "embedding"), index, semantic_weights=(1.0,)).select(
        "query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("e2_all_cells", f"""WITH {VECTOR_PARTS}, s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.e, d.e) AS score
  FROM u q, u d WHERE NOT q.old AND d.old)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) AS rank FROM s) WHERE rank <= 3""")
def _(spark, sf):
    """The approximate search with every cell is the exact one."""
    old, late = vector_parts(spark, sf)
    index = cells.build_cells(old, 16)
    found = cells.search_cells(late.select("query_id", "embedding"), index, probes=16)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("e2_approximate_recall", """WITH n AS (SELECT count(*) AS n FROM embeddings)
SELECT 16 AS cells, 12 AS probes, n - CAST(floor(n * 0.6::DOUBLE) AS BIGINT) AS queries, true AS recall_at_3 FROM n""")
def _(spark, sf):
    """Three quarters of the cells: these vectors spread evenly, so their neighbours lie in many cells."""
    old, late = vector_parts(spark, sf)
    asked = late.select("query_id", "embedding")
    exact = R.search_batch(asked, R.build_index(old, None), semantic_weights=(1.0,))
    found = cells.search_cells(asked, cells.build_cells(old, 16), probes=12)
    share = cells.recall(found, exact).first()["recall"]
    return asked.agg(F.count(F.lit(1)).alias("queries")).select(
        F.lit(16).alias("cells"), F.lit(12).alias("probes"), "queries", F.lit(share >= 0.9).alias("recall_at_3"))


def hybrid_parts(spark, sf):
    """All documents, split chronologically; half of them have a vector, whose class gives the label."""
    docs = splits.chronological_split(T.documents(spark, sf).select("doc_id", "text"), ["doc_id"]).join(
        T.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "label", "embedding"), "doc_id", "left")
    split = docs.select(
        "doc_id", "split", X.normalize_cross_domain(F.col("text")).alias("text"),
        V.unit_vector(F.col("embedding")).alias("embedding"),
        (F.coalesce(F.col("label"), F.col("doc_id") % 10) < 5).cast("int").alias("label")).persist()
    old = split.filter("split = 'train'").withColumn("doc_pos", F.col("doc_id"))
    late = split.filter("split <> 'train'").withColumnRenamed("doc_id", "query_id")
    return old, late


HYBRID = f"""{MASKED}, h AS (
  SELECT doc_id, text, CASE WHEN coalesce(label, doc_id % 10) < 5 THEN 1 ELSE 0 END AS label,
    row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n,
    list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e
  FROM masked LEFT JOIN embeddings ON doc_id = vec_id),
old AS (SELECT * FROM h WHERE pos < floor(n * 0.6::DOUBLE)),
late AS (SELECT * FROM h WHERE pos >= floor(n * 0.6::DOUBLE)),
{Q.tfidf('tv', '(SELECT doc_id, text FROM h)', 'old', min_df=2)},
lex AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.w * d.w) AS s FROM tv q JOIN tv d ON q.term = d.term
  WHERE q.doc_id IN (SELECT doc_id FROM late) AND d.doc_id IN (SELECT doc_id FROM old) GROUP BY 1, 2),
both_scores AS (SELECT q.doc_id AS query_id, q.label AS truth, d.doc_id, d.label, coalesce(list_dot_product(q.e, d.e), 0.0) AS semantic,
    coalesce(l.s, 0.0) AS lexical
  FROM late q CROSS JOIN old d LEFT JOIN lex l ON l.query_id = q.doc_id AND l.doc_id = d.doc_id)"""


def hybrid_search(spark, sf, weights, k=C.TOP_K):
    old, late = hybrid_parts(spark, sf)
    index = R.build_index(old, k=k)
    found = R.search_batch(late.select("query_id", "text", "embedding"), index, k, semantic_weights=weights)
    return R.with_documents(found, index, "label"), late.select("query_id", F.col("label").alias("true_label"))


@query("e3_hybrid_scores", f"""WITH {HYBRID}, s AS (SELECT *, 0.6::DOUBLE * semantic + 0.4::DOUBLE * lexical AS score FROM both_scores)
SELECT query_id, doc_id, rank, round(score, 6) AS score, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) AS rank FROM s)
WHERE rank <= 3""")
def _(spark, sf):
    found, _ = hybrid_search(spark, sf, (0.60,))
    return found.select("query_id", "doc_id", "rank", *[F.round(c, 6).alias(c) for c in ("score", "semantic", "lexical")])


@query("e4_top_k", f"""WITH {LEXICAL}
SELECT query_id, doc_id, rank, label FROM ranked""")
def _(spark, sf):
    found, _, _ = document_search(spark, sf)
    return found.select("query_id", "doc_id", "rank", "label")


TURNS = """asked AS (SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations WHERE trim(text) <> ''),
items AS (SELECT item_id AS doc_id, text FROM benchmark)"""


def turn_queries(spark, sf):
    turns = T.table(spark, sf, "conversations")
    return turns.filter(F.trim("text") != "").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), "text")


@query("e5_search_batch", f"""WITH {TURNS},
{Q.tfidf('qv', 'asked', 'items', min_df=1, lower=True, sublinear=False)},
{Q.tfidf('dv', 'items', 'items', min_df=1, lower=True, sublinear=False)},
s AS (SELECT a.doc_id AS query_id, i.doc_id, coalesce(p.score, 0.0) AS score FROM asked a CROSS JOIN items i
  LEFT JOIN (SELECT q.doc_id AS query_id, d.doc_id, sum(q.w * d.w) AS score FROM qv q JOIN dv d USING (term) GROUP BY 1, 2) p
  ON p.query_id = a.doc_id AND p.doc_id = i.doc_id)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) AS rank FROM s) WHERE rank <= 4""")
def _(spark, sf):
    items = T.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.col("item_id").alias("doc_pos"), "text")
    index = R.build_index(items, D.DEMO, k=4)
    return R.search_batch(turn_queries(spark, sf), index, 4).select(
        "query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("e6_evidence_summary", f"""WITH {VOTES}
SELECT query_id, CASE WHEN NOT top_similarity >= 0.55 THEN 'NEEDS_HUMAN_REVIEW'
    WHEN anomaly_votes > matches / 2.0 THEN 'LIKELY_ANOMALY' ELSE 'LIKELY_NORMAL' END AS recommendation,
  round(top_similarity, 6) AS top_similarity, round(anomaly_votes / 3.0, 6) AS anomaly_vote_ratio,
  top_similarity >= 0.55 AS has_strong_evidence FROM votes""")
def _(spark, sf):
    found, _, _ = document_search(spark, sf)
    return R.evidence_summary(found).select(
        "query_id", "recommendation", F.round("top_similarity", 6).alias("top_similarity"),
        F.round("anomaly_vote_ratio", 6).alias("anomaly_vote_ratio"), "has_strong_evidence")


def _citations(keys, query_tokens_of, lines_of):
    return f"""cand AS (
  SELECT l.*, q.toks AS qt, {Q.evidence_tokens('l.template')} AS lt FROM ({lines_of}) l JOIN ({query_tokens_of}) q USING (query_id)),
cscored AS (SELECT *, 0.6 * (len(list_intersect(qt, lt)) / len(qt)) + 0.4 * (len(list_intersect(qt, lt))
    / len(list_distinct(list_concat(qt, lt)))) AS score
  FROM cand WHERE template <> '' AND len(list_intersect(qt, lt)) > 0),
cited AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 4) DESC, pos) AS line_rank FROM cscored)"""


@query("e7_cite_lines", f"""WITH {LEXICAL}, {_citations('query_id, doc_id',
  f"SELECT doc_id AS query_id, {Q.evidence_tokens('text')} AS toks FROM asked",
  f'''SELECT query_id, doc_id, template, min(pos) AS pos FROM (
    SELECT query_id, doc_id, {Q.strip('t')} AS template, pos FROM (
      SELECT r.query_id, r.doc_id, unnest(string_split(i.text, chr(10))) AS t,
        unnest(range(len(string_split(i.text, chr(10))))) AS pos
      FROM ranked r JOIN raw_indexed i USING (doc_id))) GROUP BY 1, 2, 3''')}
SELECT query_id, doc_id, template, line_rank, round(score, 6) AS score FROM cited WHERE line_rank <= 2
""".replace(", cand AS", f""", raw_indexed AS (SELECT doc_id, string_agg({Q.cross_domain('value')}, chr(10) ORDER BY pos) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(len(string_split(text, chr(10))))) AS pos
    FROM documents) WHERE value <> '' GROUP BY doc_id), cand AS"""))
def _(spark, sf):
    found, _, asked = document_search(spark, sf)
    events = F.transform(F.split("text", "\n"), lambda m: F.struct(m.alias("message")))
    texts = T.documents(spark, sf).select(
        "doc_id", X.incident_text(events, "cross_domain_newline").alias("evidence_text"))
    pairs = found.join(texts, "doc_id").join(
        asked.withColumnRenamed("text", "query_text"), "query_id")
    cited = R.cite_lines(pairs, 2)
    return cited.select("query_id", "doc_id", "template", "line_rank", F.round("score", 6).alias("score"))


_MESSAGES = """WITH e AS (SELECT {own}, event_id AS pos, {cause} AS cause,
    lower(CASE event_type WHEN 'error' THEN 'dns exception query' WHEN 'click' THEN 'Packet to upstream' WHEN 'view' THEN 'db handler version' ELSE 'ok' END || ' ' || props) AS m FROM events),
h AS (SELECT *, CASE cause WHEN 'database' THEN contains(m,'db')::INT + contains(m,'postgres')::INT + contains(m,'query')::INT
   WHEN 'network' THEN contains(m,'packet')::INT + contains(m,'dns')::INT + contains(m,'upstream')::INT
   ELSE contains(m,'exception')::INT + contains(m,'handler')::INT + contains(m,'version')::INT END AS hits FROM e)
SELECT {keys}, pos, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY hits DESC, pos) AS rank
  FROM h WHERE hits > 0) WHERE rank <= 3"""


def messages(spark, sf):
    e = T.table(spark, sf, "events")
    message = F.concat_ws(" ", F.when(F.col("event_type") == "error", "dns exception query")
                          .when(F.col("event_type") == "click", "Packet to upstream")
                          .when(F.col("event_type") == "view", "db handler version").otherwise("ok"), F.col("props"))
    return e.select("user_id", F.col("event_id").alias("pos"), message.alias("message"))


def cause_of(number):
    return F.element_at(F.array(F.lit("database"), F.lit("network"), F.lit("application")), (number % 3 + 1).cast("int"))


@query("e8_tenant_keyword_evidence", _MESSAGES.format(
    own=f"coalesce({TENANT.format('user_id')}, '') AS organization, user_id // 6 AS incident_id",
    cause="['database','network','application'][1 + user_id % 3]", keys="organization, incident_id"))
def _(spark, sf):
    own = [tenant("user_id").alias("organization"), F.floor(F.col("user_id") / 6).alias("incident_id")]
    rows = messages(spark, sf)
    # incidents of one number differ in their cause between tenants
    causes = rows.select(*own, cause_of(F.col("user_id")).alias("root_cause")).distinct()
    found = R.keyword_evidence(rows.select(*own, "pos", "message"), causes, scope=("organization",))
    return found.select("organization", "incident_id", "pos", "hits", "rank")


@query("e8_keyword_evidence", _MESSAGES.format(
    own="user_id AS incident_id", cause="['database','network','application'][1 + user_id % 3]", keys="incident_id"))
def _(spark, sf):
    events = messages(spark, sf).withColumnRenamed("user_id", "incident_id")
    e = T.table(spark, sf, "events")
    causes = e.select(F.col("user_id").alias("incident_id")).distinct().withColumn("root_cause", cause_of(F.col("incident_id")))
    return R.keyword_evidence(events, causes).select("incident_id", "pos", "hits", "rank")


# ---- knowledge search ---------------------------------------------------------------------------
def turn_incidents(spark, sf):
    return turn_queries(spark, sf).select(
        F.col("query_id").cast("string").alias("incident_id"), F.lower("text").alias("log_text"))


EVIDENCE = f"""{A.KNOWLEDGE},
asked AS (SELECT CAST(conv_id * 100000 + turn AS VARCHAR) AS id, lower(text) AS text FROM conversations WHERE trim(text) <> ''),
{Q.tfidf('qv', 'asked', 'knowledge_text', id_column='id', lower=True, sublinear=False, stop=C.ENGLISH_STOP_WORDS)},
{Q.tfidf('dv', 'knowledge_text', 'knowledge_text', id_column='id', lower=True, sublinear=False, stop=C.ENGLISH_STOP_WORDS)},
evidence AS (SELECT q.query_id AS incident_id, q.id, q.rank, k.kind, k.title, k.root_cause, k.steps, q.score,
    round(q.score, 4) AS hybrid_similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_pos DESC) AS rank FROM (
    SELECT q.id AS query_id, d.id, k.doc_pos, sum(q.w * d.w) AS score FROM qv q JOIN dv d USING (term)
    JOIN knowledge k ON k.id = d.id GROUP BY 1, 2, 3) WHERE score > 0) q JOIN knowledge k ON k.id = q.id WHERE rank <= 4)"""


def turn_evidence(spark, sf, semantic_weight=0.0):
    index = I.knowledge_index(A._knowledge(spark, sf))
    return I.knowledge_evidence(turn_incidents(spark, sf), index, semantic_weight=semantic_weight)


@query("e9_knowledge_evidence", f"""WITH {EVIDENCE}
SELECT incident_id, id, rank, kind, title, round(score, 6) AS score FROM evidence""")
def _(spark, sf):
    return turn_evidence(spark, sf).select(
        "incident_id", "id", "rank", "kind", "title", F.round("score", 6).alias("score"))


@query("e10_build_index", f"""WITH {MASKED}, p AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos,
    count(*) OVER () AS n FROM masked), trained AS (SELECT doc_id, text FROM p WHERE pos < floor(n * 0.6::DOUBLE)),
{Q.tfidf('tv', 'trained', 'trained', min_df=2)}
SELECT term, count(*) AS postings, round(sum(w), 6) AS weight FROM tv GROUP BY 1""")
def _(spark, sf):
    split = splits.chronological_split(masked(spark, sf), ["doc_id"])
    train = split.filter("split = 'train'").select("doc_id", "text")
    counts = D.term_counts(train, D.RETRIEVAL, ["doc_id"]).persist()
    terms = D.tfidf_terms(train, D.vocabulary_from_counts(counts, train, D.RETRIEVAL), counts=counts)
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("postings"), F.round(F.sum("weight"), 6).alias("weight"))


@query("e10_stored_index", f"""WITH {LEXICAL}
SELECT query_id, doc_id, rank, label, round(score, 6) AS score FROM ranked""")
def _(spark, sf):
    docs, labels = masked(spark, sf).persist(), T.labelled(spark, sf)
    known = docs.join(labels, "doc_id").withColumn("doc_pos", F.col("doc_id"))
    path = A.scratch(spark, "evidence-index") + "/version-1"
    R.save_index(R.build_index(known), path)
    index = R.load_index(spark, path)
    asked = docs.join(labels, "doc_id", "left_anti").withColumnRenamed("doc_id", "query_id")
    found = R.with_documents(R.search_batch(asked, index), index, "label")
    return found.select("query_id", "doc_id", "rank", "label", F.round("score", 6).alias("score"))


@query("d7_encoder", """SELECT doc_id, round(length(text) / sqrt(length(text)::DOUBLE ^ 2 + 1), 6) AS first,
  2 AS width FROM documents""")
def _(spark, sf):
    def encoder(texts):  # a stand-in for a caller's model
        return [[float(len(t)), 1.0] for t in texts]
    found = V.embed_texts(T.documents(spark, sf).select("doc_id", "text"), encoder)
    return found.select("doc_id", F.round(F.element_at("embedding", 1), 6).alias("first"), F.size("embedding").alias("width"))


def per_tenant(sql: str, select: str) -> str:
    """``sql`` (CTEs over benchmark and conversations) for each tenant; ids repeat between tenants."""
    def of(t: int) -> str:
        own = sql.replace("FROM benchmark)", f"FROM benchmark WHERE item_id % 3 = {t})")
        own = own.replace("'KB-' || item_id AS id", "'KB-' || (item_id // 3) AS id")
        own = own.replace("FROM conversations WHERE", f"FROM conversations WHERE conv_id % 3 = {t} AND")
        own = own.replace("conv_id * 100000 + turn", "(conv_id // 3) * 100000 + turn")
        name = ("''", "'a'", "'b'")[t]
        return f"SELECT * FROM (WITH {own} SELECT {name} AS organization, {select.replace('{t}', str(t))})"
    return " UNION ALL ".join(map(of, range(3)))


def tenant_knowledge(spark, sf):
    k = A._knowledge(spark, sf)
    return k.withColumn("organization", tenant("doc_pos")).withColumn(
        "id", F.concat(F.lit("KB-"), F.floor(F.col("doc_pos") / 3).cast("string")))


def tenant_incidents(spark, sf):
    turns = T.table(spark, sf, "conversations").filter(F.trim("text") != "")
    return turns.select(
        (F.floor(F.col("conv_id") / 3) * 100000 + F.col("turn")).cast("string").alias("incident_id"),
        tenant("conv_id").alias("organization"), F.lower("text").alias("log_text"))


@query("e9_tenant_evidence", per_tenant(EVIDENCE, "incident_id, id, rank, title, root_cause, round(score, 6) AS score FROM evidence"))
def _(spark, sf):
    index = I.knowledge_index(tenant_knowledge(spark, sf), scope=("organization",))
    found = I.knowledge_evidence(tenant_incidents(spark, sf), index, semantic_weight=0.0)
    return found.select("organization", "incident_id", "id", "rank", "title", "root_cause", F.round("score", 6).alias("score"))


def _tenant_sql(select: str) -> str:
    return f"""WITH {T.LABELLED}, d AS (SELECT doc_id // 3 AS doc_id, label IS NOT NULL AS known, label,
  coalesce({TENANT.format('doc_id')}, '') AS org, lower(text) AS text FROM documents LEFT JOIN labelled USING (doc_id)),
k AS (SELECT * FROM d WHERE known), q AS (SELECT * FROM d WHERE NOT known),
c AS (SELECT doc_id, org, known, term, count(*) AS tf FROM (SELECT doc_id, org, known, unnest({Q.grams('toks')}) AS term
  FROM (SELECT doc_id, org, known, {Q.tokens('text')} AS toks FROM d)) GROUP BY 1, 2, 3, 4),
voc AS (SELECT org, term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM c
  JOIN (SELECT org, count(*) AS n FROM k GROUP BY 1) USING (org) WHERE known GROUP BY 1, 2),
r AS (SELECT doc_id, org, known, term, tf * idf AS w FROM c JOIN voc USING (org, term)),
v AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY org, known, doc_id)) AS u FROM r),
p AS (SELECT a.org, a.doc_id AS query_id, b.doc_id, sum(a.u * b.u) AS score FROM v a JOIN v b ON a.org = b.org AND a.term = b.term
  WHERE NOT a.known AND b.known GROUP BY 1, 2, 3),
s AS (SELECT q.org, q.doc_id AS query_id, k.doc_id, k.text, k.label, coalesce(p.score, 0.0) AS score FROM q JOIN k USING (org) LEFT JOIN p
  ON p.org = q.org AND p.query_id = q.doc_id AND p.doc_id = k.doc_id),
ranked AS (SELECT org AS organization, query_id, doc_id, rank, text, label, score FROM (SELECT *, row_number() OVER (
  PARTITION BY org, query_id ORDER BY round(score, 9) DESC, doc_id DESC) AS rank FROM s) WHERE rank <= 3),
votes AS (SELECT organization, query_id, max(score) FILTER (rank = 1) AS top_similarity, max(label) FILTER (rank = 1) AS evidence_label,
  min(label) = max(label) AS unanimous, CAST(sum(label) AS BIGINT) AS anomaly_votes, count(*) AS matches FROM ranked GROUP BY 1, 2)
{select}"""


def tenant_search(spark, sf):
    """Each tenant's unlabelled documents against its labelled ones; ids repeat between the three tenants."""
    docs = T.documents(spark, sf).select("doc_id", tenant("doc_id").alias("organization"), F.lower("text").alias("text"))
    own = F.floor(F.col("doc_id") / 3)
    known = docs.join(T.labelled(spark, sf), "doc_id").withColumn("doc_id", own).withColumn("doc_pos", F.col("doc_id"))
    asked = docs.join(T.labelled(spark, sf), "doc_id", "left_anti").select(own.alias("query_id"), "organization", "text")
    index = R.build_index(known, D.DEMO, scope=("organization",))
    return R.with_documents(R.search_batch(asked, index), index, "text", "label")


@query("e11_tenant_index", _tenant_sql(
    "SELECT organization, query_id, doc_id, rank, md5(text) AS content, round(score, 6) AS score FROM ranked"))
def _(spark, sf):
    return tenant_search(spark, sf).select(
        "organization", "query_id", "doc_id", "rank", F.md5("text").alias("content"), F.round("score", 6).alias("score"))


@query("e6_tenant_summary", _tenant_sql("""SELECT organization, query_id, CASE WHEN NOT top_similarity >= 0.2 THEN 'NEEDS_HUMAN_REVIEW'
    WHEN anomaly_votes > matches / 2.0 THEN 'LIKELY_ANOMALY' ELSE 'LIKELY_NORMAL' END AS recommendation,
  round(top_similarity, 6) AS top_similarity, round(anomaly_votes / matches, 6) AS anomaly_vote_ratio FROM votes"""))
def _(spark, sf):
    found = R.evidence_summary(tenant_search(spark, sf), 0.2, scope=("organization",))
    return found.select("organization", "query_id", "recommendation", F.round("top_similarity", 6).alias("top_similarity"),
                        F.round("anomaly_vote_ratio", 6).alias("anomaly_vote_ratio"))


@query("g15_tenant_decision", _tenant_sql("""SELECT organization, query_id, CASE WHEN top_similarity >= 0.2 AND unanimous AND evidence_label = 1 THEN 'LIKELY_ANOMALY'
    WHEN top_similarity >= 0.2 AND unanimous THEN 'LIKELY_NORMAL' ELSE 'NEEDS_HUMAN_REVIEW' END AS recommendation,
  evidence_label, unanimous, anomaly_votes FROM votes"""))
def _(spark, sf):
    found = R.retrieval_decision(tenant_search(spark, sf), 0.2, scope=("organization",))
    return found.select("organization", "query_id", "recommendation", "evidence_label", "unanimous", "anomaly_votes")
