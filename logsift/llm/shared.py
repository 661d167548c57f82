"""Session-side helpers of the operators: lineage cuts, checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast only when its rows times its row bytes were counted to fit this.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once all that reads them was written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checked_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast if counting shows that it is small; else as it is.

    ``df`` must be read from a table (see ``cut``), so that counting does not repeat work.
    """
    limit = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keys(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """``docs`` with a long ``key``, one for each pair of id and text; False if it is the id itself.

    Keys ascend with the id, for one id with a digest of the text; rows without id come
    last. Only where an id is missing or repeated does the key differ from the id.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    odd = cut(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"))
    if odd.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), False
    number, digest = f"{key}_id", f"{key}_digest"
    text = F.col("text").cast("string")
    named = docs.withColumns({number: F.col("doc_id").cast("long"), digest: F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(""))})
    order = [F.col(number).asc_nulls_last(), F.col(digest).asc()]
    keys = cut(named.select(number, digest).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn(key, F.monotonically_increasing_id()))
    other = checked_broadcast(keys, 112).select(F.col(number).alias(f"{number}2"), F.col(digest).alias(f"{digest}2"), key)
    same = F.col(number).eqNullSafe(F.col(f"{number}2")) & (F.col(digest) == F.col(f"{digest}2"))
    return cut(named.join(other, same).select(*docs.columns, key)), True


def one_row_per_key(docs: DataFrame, key: str) -> DataFrame:
    """One of the rows that share a key, that is, an id and a text."""
    repeated = cut(docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if repeated.isEmpty():
        return docs
    row = f"{key}_row"
    again = (
        docs.join(repeated, key, "left_semi").select(key, F.struct(*docs.columns).alias(row))
        .groupBy(key).agg(F.first(row).alias(row)).select(f"{row}.*")
    )
    return cut(docs.join(repeated, key, "left_anti").select(*docs.columns).unionByName(again))


def distinct_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with an id, equal ones once, under a unique doc_id: (docs, ids).

    Different texts of one id are documents of their own. Where there are any, ``doc_id`` of
    the rows is a key that ascends with the id and ``ids`` (key, doc_id) names them again
    (see ``with_own_ids``); else ``ids`` is None.
    """
    docs = docs.where("doc_id IS NOT NULL")
    keyed, odd = row_keys(docs, "_key")
    if not odd:
        return docs, None
    keyed = one_row_per_key(keyed, "_key")
    return keyed.withColumn("doc_id", F.col("_key")).select(*docs.columns), keyed.select("_key", "doc_id")


def with_own_ids(found: DataFrame, ids: DataFrame | None, *names: str) -> DataFrame:
    """``found`` with ids in place of the keys in the columns ``names``."""
    if ids is None:
        return found
    columns = found.columns
    for name in names:
        found = found.withColumnRenamed(name, "_key").join(checked_broadcast(ids.withColumnRenamed("doc_id", name), 48), "_key").drop("_key")
    return found.select(*columns)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of ``edges`` (a, b): (node, component).

    Alternates large-star and small-star: each node's neighbours are linked to its smallest
    neighbour, which only needs minima per node, until every edge points at its component's
    smallest node. No node's neighbourhood is ever gathered, so a hub may be of any degree.
    """
    edges = cut(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b")
        large = large.where("a <> b").distinct()
        smaller = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smaller, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                      F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct()
        )
        edges = cut(small)
        # done when no node is both below something and above something
        if edges.select("a").intersect(edges.select("b")).isEmpty():
            return edges.selectExpr("a AS node", "b AS component")
