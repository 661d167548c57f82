"""A training corpus from raw documents: quality, near copies, repeated passages, benchmark
leaks, token ids.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last
one with the token ids besides. ``run`` writes each stage's rows as Parquet to the shared
folder and reads them again for the next. The stages that compare documents do so under a
key of their own (``row_keys``): rows without doc_id are documents like others, after all
that have one, and different texts of one id are different documents. Rows with the same id
(or none) and the same text count once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from logsift.llm import pieces, quality
from logsift.llm.decontamination import contaminated
from logsift.llm.near_duplicates import near_duplicates
from logsift.llm.shared import checked_broadcast, cut, free_name, one_row_per_key, row_keys, shared_folder
from logsift.llm.substring_dedup import substring_dedup


def _apart(docs: DataFrame, *kept: str) -> DataFrame:
    """The documents' columns under names that no operator's result has, but for text and ``kept``."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("text", *kept) else f"own_{k}") for k, c in enumerate(docs.columns)])


def _together(rows: DataFrame, docs: DataFrame, *kept: str) -> DataFrame:
    """``rows`` of ``_apart`` under the documents' own names."""
    return rows.select(*[F.col(c if c in ("text", *kept) else f"own_{k}").alias(c) for k, c in enumerate(docs.columns)])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.5 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_quality(_apart(docs, "doc_id"), labels).where("score >= 0.5")
    return _together(scored, docs, "doc_id")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies (five-word shingles)."""
    key = free_name("row_key", docs.columns)
    keyed, odd = row_keys(docs, key)
    keyed = one_row_per_key(keyed, key) if odd else keyed
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), shingle=5)
    dropped = cut(found.where("NOT kept").select(F.col("doc_id").alias(key)))
    return keyed.join(checked_broadcast(dropped, 32), key, "left_anti").select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that a smaller document has too.

    A text that loses nothing stays as it is, the words left of another are joined by one
    space; a document that loses all its words leaves.
    """
    key = free_name("row_key", docs.columns)
    keyed, _ = row_keys(docs, key)
    # the documents' columns under names that no result has
    own = {c: f"own_{k}" for k, c in enumerate(docs.columns) if c != "text"}
    found = substring_dedup(keyed.select(F.col(key).alias("doc_id"), "text", *[F.col(f"`{c}`").alias(n) for c, n in own.items()]), with_text=True)
    touched = F.col("n_removed") > 0
    text = F.when(touched, F.col("kept_text")).otherwise(F.col("text"))
    rows = found.where("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    if "n_chars" in own:
        rows = rows.withColumn(own["n_chars"], F.when(touched, F.length("text").cast("long")).otherwise(F.col(own["n_chars"])))
    return rows.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def without_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = free_name("row_key", docs.columns)
    keyed, _ = row_keys(docs, key)
    found = contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), items)
    leaks = cut(found.select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(checked_broadcast(leaks, 32), key, "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids, each decoded again and compared.

    A document's own column ``ids`` or ``restored`` stays; the new one then gets underscores behind its name.
    """
    decoded = pieces.encode_and_decode(_apart(docs), keep=False)
    own = [F.col("text" if c == "text" else f"own_{k}").alias(c) for k, c in enumerate(docs.columns)]
    return decoded.select(
        *own, F.col("ids").alias(free_name("ids", docs.columns)),
        F.col("decoded").eqNullSafe(F.col("text")).alias(free_name("restored", docs.columns)))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("substrings", without_repeated_passages),
    ("benchmark", without_benchmark_leaks),
    ("pieces", token_ids),
]

#: The stages fit a model and compare hashed shingles; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
