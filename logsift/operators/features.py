"""Exact TF-IDF as tables, class and domain weights."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logsift import constants as C
from logsift.functions import text as X, vectors as V
from logsift.operators.ordering import BROADCAST_ROWS, attach, attach_parts, dense_index


@dataclass(frozen=True)
class TextOptions:
    """How documents become terms and weights."""

    lowercase: bool = False
    min_df: int = 1
    max_features: int | None = None
    sublinear: bool = True
    stop_words: Sequence[str] = ()


RETRIEVAL = TextOptions(lowercase=False, min_df=2, sublinear=True)
KNOWLEDGE = TextOptions(lowercase=True, min_df=1, sublinear=False, stop_words=C.ENGLISH_STOP_WORDS)
DEMO = TextOptions(lowercase=True, min_df=1, sublinear=False)
CLASSIC = TextOptions(lowercase=True, min_df=2, max_features=50_000, sublinear=False)
FOREST = TextOptions(lowercase=True, min_df=2, max_features=5_000, sublinear=False)
FEEDBACK = TextOptions(lowercase=True, min_df=1, sublinear=True)


@dataclass(frozen=True)
class Vocabulary:
    """Fitted terms: one row per (scope..., term) with ``term_id``, ``df`` and ``idf``."""

    terms: DataFrame
    options: TextOptions
    scope: tuple[str, ...] = ()


def term_arrays(docs: DataFrame, options: TextOptions, keys: Sequence[str]) -> DataFrame:
    """The n-gram list ``_grams`` of each text.

    Tokens are a column of their own: inside one expression they would be extracted
    again for each use.
    """
    tokens = X.feature_tokens(F.col("text"), options.lowercase)
    if options.stop_words:
        tokens = X.without_words(tokens, options.stop_words)
    return docs.select(*keys, tokens.alias("_tokens")).select(
        *keys, X.with_bigrams(F.col("_tokens")).alias("_grams")
    )


def term_counts(docs: DataFrame, options: TextOptions, keys: Sequence[str]) -> DataFrame:
    """One row per (document, term) with ``tf``.

    The texts are placed by document before they are cut into terms. Counting, norms and
    packing then all find a document's terms in one partition, and the terms themselves,
    far more bytes than the texts, are never shuffled.
    """
    # as many partitions as the session has for a shuffle (``_placed``): merged ones, sized by their texts, hold many times that in terms
    return count_terms(term_arrays(_placed(docs.select(*keys, "text"), keys), options, keys), keys)


def _placed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by document, always in the same number of partitions: two such tables put together stay placed."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *[F.col(k) for k in keys])


def count_terms(docs: DataFrame, keys: Sequence[str], grams: str = "_grams") -> DataFrame:
    # explode_outer: for explode the optimizer adds a size filter and pushes it below the
    # tokenizer by substitution, which then runs the masks and the tokenizer many times
    return (
        docs.select(*keys, F.explode_outer(grams).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def fit_vocabulary(
    docs: DataFrame, options: TextOptions, id_column: str = "doc_id", scope: Sequence[str] = ()
) -> Vocabulary:
    """D2 and the idf of D3.

    ``scope`` columns (organization, version) fit one vocabulary per scope. A term's id
    is its 64-bit hash, so no global numbering is needed; a clash raises.
    """
    scope = tuple(scope)
    counts = term_counts(docs, options, [*scope, id_column])
    return vocabulary_from_counts(counts, docs, options, scope)


def vocabulary_from_counts(
    counts: DataFrame, docs: DataFrame, options: TextOptions, scope: tuple[str, ...] = ()
) -> Vocabulary:
    terms = (
        counts.groupBy(*scope, "term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        .filter(F.col("df") >= options.min_df)
    )
    if options.max_features is not None:
        if scope:
            raise ValueError("max_features applies to one corpus, not to scopes")
        terms = terms.orderBy(F.desc("total"), "term").limit(options.max_features)
    if scope:
        sizes = docs.groupBy(*scope).agg(F.count(F.lit(1)).alias("_docs"))
        terms = attach(terms, sizes, list(scope))
    else:
        terms = terms.withColumn("_docs", F.lit(docs.count()))
    fitted = terms.select(
        *scope,
        "term",
        F.xxhash64("term").alias("term_id"),
        "df",
        "total",
        (F.log((1.0 + F.col("_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
    )
    # read for its size, for the index and for every batch of queries
    return Vocabulary(fitted.persist(), options, scope)


def assert_distinct_ids(vocabulary: Vocabulary) -> None:
    """Raise if two terms share a hash id; run once when a vocabulary is saved."""
    clash = (
        vocabulary.terms.groupBy(*vocabulary.scope, "term_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    if not clash.isEmpty():
        raise RuntimeError("Two vocabulary terms share a hash id.")


def weigh_parts(counts: DataFrame, vocabulary: Vocabulary, keys: Sequence[str]) -> list[DataFrame]:
    """Counts joined with a vocabulary: (keys, term, term_id, weight before the norm), as one part or two.

    The rows of the first part (all terms, or the frequent ones) stay where the counts are.
    """
    tf = F.col("tf").cast("double")
    if vocabulary.options.sublinear:
        tf = 1.0 + F.log(tf)
    terms = vocabulary.terms.select(*vocabulary.scope, "term", "term_id", "idf", "df")
    limit = vocabulary.options.max_features
    if limit is not None and limit <= BROADCAST_ROWS:
        parts = [counts.join(F.broadcast(terms), "term")]
    else:
        parts = attach_parts(counts, terms, [*vocabulary.scope, "term"], "df")
    return [part.select(*keys, "term", "term_id", (tf * F.col("idf")).alias("weight")) for part in parts]


def _with_terms(ids: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """``ids`` with ``_pairs``, each document's terms and weights (null without any). The first part is collected in place."""
    rows, names = ids, []
    for n, part in enumerate(parts):
        names.append(f"_pairs{n}")
        terms = part.groupBy(*keys).agg(F.collect_list(F.struct("term_id", "weight")).alias(names[-1]))
        rows = rows.join(terms, list(keys), "left")
    if len(names) == 1:
        return rows.withColumnRenamed("_pairs0", "_pairs")
    one, other = names
    return rows.withColumn("_pairs", F.coalesce(F.concat(one, other), one, other)).drop(*names)


def tfidf(
    docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id"
) -> DataFrame:
    """D3 packed: one row per document with ``term_ids`` and unit-norm ``weights``.

    Documents without a known term are kept with empty arrays. Packing is bounded by
    the terms of one text, which already sits in one row.
    """
    keys = [*vocabulary.scope, id_column]
    counts = term_counts(docs, vocabulary.options, keys)
    return pack(weigh_parts(counts, vocabulary, keys), docs.select(*keys), keys)


def pack(weighted: Sequence[DataFrame], ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _with_terms(ids, weighted, keys).select(
        *keys,
        F.coalesce(F.col("_pairs.term_id"), F.array().cast("array<bigint>")).alias("term_ids"),
        F.coalesce(V.unit_weights(F.col("_pairs.weight")), F.array().cast("array<double>")).alias("weights"),
    )


def tfidf_terms(
    docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id",
    counts: DataFrame | None = None,
) -> DataFrame:
    """D3 as a long table (document, term, weight) with unit-norm rows."""
    keys = [*vocabulary.scope, id_column]
    if counts is None:
        counts = term_counts(docs, vocabulary.options, keys)
    # frequent terms lie by document, as ``term_counts`` left them; with rare ones beside them norms need no other shuffle
    frequent, *rare = weigh_parts(counts, vocabulary, keys)
    weighted = functools.reduce(DataFrame.unionByName, [_placed(part, keys) for part in rare], frequent)
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(*keys)))
    return weighted.select(*keys, "term", (F.col("weight") / length).alias("weight"))


def vector_rows(
    ids: DataFrame, weighted: Sequence[DataFrame] | None, keys: Sequence[str], extra: Sequence[str] = ()
) -> DataFrame:
    """One row per document for matching: ``term_ids``, ``weights`` and ``extra`` columns (position, embedding).

    Weights are those of ``weigh_parts``; matching norms them. A document without a term has nulls.
    The first part keeps a document's terms in one partition, so only ``ids`` and rare terms move.
    """
    rows = ids.select(*keys, *extra)
    if weighted is None:
        return rows
    return _with_terms(rows, weighted, keys).select(
        *keys, *extra, F.col("_pairs.term_id").alias("term_ids"), F.col("_pairs.weight").alias("weights"))


def numbered_vocabulary(vocabulary: Vocabulary) -> tuple[Vocabulary, int]:
    """The vocabulary with dense feature numbers in term order as ids, and its size.

    Numbering writes the table once, so later joins do not fit it again.
    """
    numbered = dense_index(vocabulary.terms, F.col("term"), name="feature")
    terms = numbered.withColumn("term_id", F.col("feature"))
    return Vocabulary(terms, vocabulary.options, vocabulary.scope), terms.count()


def jvm_features(docs: DataFrame, vocabulary: Vocabulary, size: int, id_column: str = "doc_id") -> DataFrame:
    """D4 without Python: (id, ``features``) by Spark ML's own counting, scaling and norm.

    For a numbered vocabulary without scope, without sublinear counts and of at most ``BROADCAST_ROWS`` terms,
    which the transformers hold (see ``to_sparse`` for the others).
    """
    if vocabulary.scope or vocabulary.options.sublinear or size > BROADCAST_ROWS:
        raise ValueError("Counted features need a small vocabulary without scope and sublinear counts.")
    grams = term_arrays(docs, vocabulary.options, [id_column]).withColumn(
        "_grams", F.coalesce("_grams", F.array().cast("array<string>")))
    if not size:
        return grams.select(id_column, array_to_vector(F.array().cast("array<double>")).alias("features"))
    rows = vocabulary.terms.select("term_id", "term", "idf").orderBy("term_id").collect()  # size terms
    counted = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol="_grams", outputCol="_counts").transform(grams)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_counts", outputCol="_weighed").transform(counted)
    return Normalizer(p=2.0, inputCol="_weighed", outputCol="features").transform(scaled).select(id_column, "features")


# Vectors travel in Arrow batches; Spark SQL has no expression that makes a sparse one
@F.udf(VectorUDT(), useArrow=True)
def _sparse(size, indices, values):
    return SparseVector(size, indices, values)


def to_sparse(packed: DataFrame, size: int) -> DataFrame:
    """Adds ``features`` for Spark ML to rows packed under a numbered vocabulary."""
    pairs = F.sort_array(F.arrays_zip("term_ids", "weights"))
    return packed.withColumn("_pairs", pairs).withColumn(
        "features", _sparse(F.lit(size), F.col("_pairs.term_ids"), F.col("_pairs.weights"))
    ).drop("_pairs")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` = n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).collect()
    total, classes = sum(r["_n"] for r in counts), len(counts)
    weight = None
    for row in counts:
        value = F.lit(total / (classes * row["_n"]))
        match = F.col(label) == F.lit(row[label])
        weight = F.when(match, value) if weight is None else weight.when(match, value)
    return df.withColumn("weight", weight if weight is not None else F.lit(None).cast("double"))


def domain_weights(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Both domains get half of the total weight, which sums to the row count."""
    counts = {r[domain]: r["count"] for r in df.groupBy(domain).count().collect()}
    total, weight = sum(counts.values()), F.lit(None).cast("double")
    for value, rows in counts.items():
        weight = F.when(F.col(domain) == value, F.lit(0.5 / rows * total)).otherwise(weight)
    return df.withColumn("domain_weight", weight)
