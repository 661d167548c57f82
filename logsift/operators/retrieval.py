"""Evidence search over labelled incidents, and what follows from matches."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsift import constants as C
from logsift.functions import text as X
from logsift.operators import features as D
from logsift.operators.matching import match_blocks, pack_blocks, reduce_copies
from logsift.operators.ordering import top_per_group
from logsift.session import cut_lineage

# Rows, and bytes of text and vectors, that a block holds; a task works on one query block
# and one index block.
BLOCK_BYTES = 4_000_000
BLOCK_ROWS = 4_000
# Documents of a packed index block: the unit that a task reads.
INDEX_BLOCK_ROWS = 1_000
# An index of up to this many blocks is dealt out to that many partitions, however many it was made in.
FEW_BLOCKS = 8


@dataclass(frozen=True)
class EvidenceIndex:
    """A labelled corpus prepared for search."""

    documents: DataFrame  # doc_id, doc_pos, label, text, [scope...] (see in_scope), [embedding]
    packed: DataFrame  # blocks of their vectors (pack_blocks)
    vocabulary: D.Vocabulary | None
    blocks: int
    scope: tuple[str, ...] = ()


def _blocks(df: DataFrame) -> int:
    """Blocks by rows and bytes. Each block of one side is sent once per block of the other,
    so their number follows the data; more cores only take more of the block pairs."""
    size = sum((F.coalesce(c, F.lit(0)) for c in (
        *([F.octet_length("text")] if "text" in df.columns else []),
        *([4 * F.size("embedding")] if "embedding" in df.columns else []))), F.lit(0))
    rows, weight = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return max(1, -(-(rows or 0) // BLOCK_ROWS), -(-(weight or 0) // BLOCK_BYTES))


def in_scope(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Scope columns as text; rows without an organization share the bundled scope ''."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in scope})


def build_index(
    documents: DataFrame,
    options: D.TextOptions | None = D.RETRIEVAL,
    *,
    scope: Sequence[str] = (),
    k: int = C.TOP_K,
) -> EvidenceIndex:
    """Index of the given documents only (pass the training part).

    With ``scope`` (organization, version) every statistic and match stays inside a scope.
    ``options=None`` makes a dense-only index.
    """
    scope = tuple(scope)
    documents = in_scope(documents, scope)
    keys = [*scope, "doc_id"]
    content = [c for c in ("text", "embedding") if c in documents.columns]
    extra = ["doc_pos", *[c for c in content if c == "embedding"]]
    reduced = reduce_copies(documents.select(*keys, "doc_pos", *content), k, content, scope)
    vocabulary = weighted = None
    if options is not None:
        counts = D.term_counts(documents, options, keys).persist()
        vocabulary = D.vocabulary_from_counts(counts, documents, options, scope)
        weighted = D.weigh_parts(counts, vocabulary, keys)
    blocks = _blocks(documents)
    rows = D.vector_rows(reduced, weighted, keys, extra)
    packed = packed_index(rows.repartition(blocks, *keys) if blocks <= FEW_BLOCKS else rows, scope)
    if options is not None:
        counts.unpersist()
    return EvidenceIndex(documents, packed, vocabulary, blocks, scope)


def packed_index(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Vectors of documents as blocks, written once: every search reads them."""
    return cut_lineage(pack_blocks(rows, "doc_id", scope, min(BLOCK_ROWS, INDEX_BLOCK_ROWS)))


def save_index(index: EvidenceIndex, path: str) -> None:
    """Write an index as tables under ``path`` (one folder per version), to be searched many times."""
    index.documents.write.parquet(f"{path}/documents")
    index.packed.write.parquet(f"{path}/blocks")
    about = {"blocks": index.blocks, "scope": list(index.scope), "options": None}
    if index.vocabulary is not None:
        index.vocabulary.terms.write.parquet(f"{path}/terms")
        about["options"] = {**asdict(index.vocabulary.options), "stop_words": list(index.vocabulary.options.stop_words)}
    spark = index.documents.sparkSession
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{path}/about")


def load_index(spark: SparkSession, path: str) -> EvidenceIndex:
    """An index as ``save_index`` wrote it."""
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    vocabulary = None
    if about["options"] is not None:
        options = D.TextOptions(**{**about["options"], "stop_words": tuple(about["options"]["stop_words"])})
        vocabulary = D.Vocabulary(spark.read.parquet(f"{path}/terms"), options, tuple(about["scope"]))
    return EvidenceIndex(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/blocks"),
                         vocabulary, about["blocks"], tuple(about["scope"]))


def search_batch(
    queries: DataFrame,
    index: EvidenceIndex,
    k: int = C.TOP_K,
    *,
    semantic_weights: Sequence[float] = (0.0,),
) -> DataFrame:
    """The k most similar indexed documents of every query.

    ``queries``: query_id, text and/or embedding. They are packed at once; a query with
    blank text raises, an empty batch gives an empty result. Unknown-term queries still get k
    documents, at similarity zero.
    """
    keys = [*index.scope, "query_id"]
    queries = in_scope(queries, index.scope)
    weighted = None
    if index.vocabulary is not None:
        blank = F.raise_error(F.lit("Query text cannot be empty.")).cast("string")
        checked = queries.withColumn(
            "text", F.when(X.strip(F.col("text")) == "", blank).otherwise(F.col("text"))
        )
        counts = D.term_counts(checked, index.vocabulary.options, keys)
        weighted = D.weigh_parts(counts, index.vocabulary, keys)
    extra = ["embedding"] if "embedding" in queries.columns else []
    asked = pack_blocks(D.vector_rows(queries, weighted, keys, extra), "query_id", index.scope, BLOCK_ROWS)
    return match_blocks(asked, index.packed, k, semantic_weights=semantic_weights, scope=index.scope)


def with_documents(matches: DataFrame, index: EvidenceIndex, *columns: str) -> DataFrame:
    """Add columns of the matched documents (label, text, ...)."""
    keys = [*index.scope, "doc_id"]
    return matches.join(index.documents.select(*keys, *columns), keys)


def evidence_aggregate(matches: DataFrame, *keys: str) -> DataFrame:
    """Per query: top score, labels by rank, unanimity and votes of its k matches."""
    return matches.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_similarity"),
        F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("evidence_label"),
        (F.min("label") == F.max("label")).alias("unanimous"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("anomaly_votes"),
        F.count(F.lit(1)).alias("matches"),
    )


def evidence_summary(
    matches: DataFrame, minimum_similarity: float = 0.55, key: str = "query_id", scope: Sequence[str] = (),
) -> DataFrame:
    """Majority vote of the matches, review when the best one is too weak.

    After a scoped search ids may repeat between tenants: pass the same ``scope``.
    """
    votes = evidence_aggregate(matches, *scope, key)
    strong = F.col("top_similarity") >= minimum_similarity
    return votes.select(
        *scope,
        key,
        F.when(~strong, C.NEEDS_REVIEW)
        .when(F.col("anomaly_votes") > F.col("matches") / 2, C.LIKELY_ANOMALY)
        .otherwise(C.LIKELY_NORMAL)
        .alias("recommendation"),
        "top_similarity",
        (F.col("anomaly_votes") / F.col("matches")).alias("anomaly_vote_ratio"),
        strong.alias("has_strong_evidence"),
    )


def retrieval_decision(
    matches: DataFrame,
    minimum_score: float = C.DEPLOYED_MINIMUM_SCORE,
    key: str = "query_id",
    scope: Sequence[str] = (),
) -> DataFrame:
    """The common label of the matches if the best one is strong enough.

    ``scope`` as in the search that found them.
    """
    votes = evidence_aggregate(matches, *scope, key)
    passed = (F.col("top_similarity") >= minimum_score) & F.col("unanimous")
    return votes.select(
        *scope,
        key,
        F.when(passed & (F.col("evidence_label") == 1), C.LIKELY_ANOMALY)
        .when(passed, C.LIKELY_NORMAL)
        .otherwise(C.NEEDS_REVIEW)
        .alias("recommendation"),
        "top_similarity",
        "evidence_label",
        "unanimous",
        "anomaly_votes",
    )


def _line_score(query_tokens: Column, line_tokens: Column) -> Column:
    shared = F.size(F.array_intersect(query_tokens, line_tokens))
    union = F.size(query_tokens) + F.size(line_tokens) - shared
    return 0.6 * (shared / F.size(query_tokens)) + 0.4 * (shared / union)


def cite_lines(
    pairs: DataFrame,
    max_lines: int = 3,
    keys: Sequence[str] = ("query_id", "doc_id"),
    query: str = "query_text",
    evidence: str = "evidence_text",
    scope: Sequence[str] = (),
) -> DataFrame:
    """The evidence lines that share most technical tokens with the query.

    One row per cited line of a pair, which is named by ``scope`` and ``keys``. Equal lines of one text count once, at their first place;
    equal scores (to four decimals) keep the order of the text.
    """
    keys = [*scope, *keys]
    lines = (
        pairs.withColumn("_query_tokens", X.meaningful_tokens(F.col(query)))
        .select(
            *keys, "_query_tokens",
            F.posexplode(F.array_distinct(
                F.transform(F.split(F.col(evidence), "\n"), X.strip)
            )).alias("_pos", "template"),
        )
        .withColumn("_line_tokens", X.meaningful_tokens(F.col("template")))
    )
    scored = (
        lines.filter(F.col("template") != "")
        .withColumn("score", _line_score(F.col("_query_tokens"), F.col("_line_tokens")))
        .filter(F.arrays_overlap("_query_tokens", "_line_tokens"))
        .select(*keys, "template", "score", "_pos")
    )
    return top_per_group(
        scored, keys, [F.desc(F.round("score", 4)), F.asc("_pos")], max_lines, "line_rank"
    ).drop("_pos")


def keyword_evidence(
    events: DataFrame, causes: DataFrame, key: str = "incident_id", scope: Sequence[str] = (),
) -> DataFrame:
    """Up to three events naming most keywords of the predicted cause.

    ``events``: scope, key, pos, message. ``causes``: scope, key, root_cause.
    """
    keys = [*scope, key]
    events, causes = in_scope(events, scope), in_scope(causes, scope)
    hits = F.lit(0)
    for cause, words in C.CAUSE_EVIDENCE_KEYWORDS.items():
        found = sum(
            (F.lower("message").contains(word).cast("int") for word in words), F.lit(0)
        )
        hits = F.when(F.col("root_cause") == cause, found).otherwise(hits)
    # a key's events are cut to three in every partition before they meet
    scored = events.join(causes.select(*keys, "root_cause"), keys).withColumn("hits", hits)
    return top_per_group(
        scored.filter(F.col("hits") > 0), keys, [F.desc("hits"), F.asc("pos")], 3
    )
