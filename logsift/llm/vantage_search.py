"""Approximate nearest neighbours by inner product: vantage-point trees per shard.

Largest inner product is turned into least distance: with M the largest norm, a vector x
gets one more coordinate sqrt(M^2 - |x|^2) and a query gets 0, so that their squared
distance is |q|^2 + M^2 - 2 q.x, and the triangle inequality holds. Vectors are dealt to
shards of bounded size; a task builds the tree of its shard and answers all queries of a
query group, in blocks. A node keeps a vantage point and, for its two halves, the range of
distances to it. A half is left out when ``factor`` times its lower bound (the distance of
the query's ring from the half's) reaches the query's ``k``-th best so far; factor 1 keeps
the search exact, more prunes earlier. Leaves are compared by matrix products.

Equal vectors form one class with its ``k + 1`` smallest ids, which is all that any query
can return of it, so copies cost one entry, however many there are.

Vectors that are null, zero, of another length than the most common one (ties: the longer)
or hold null or non-finite components take no part, as base or as query. Ties go to the
smaller id, repeated rows of one id count once (the smallest vector), a null id takes no
part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logsift.llm.shared import cut

SHARD_ROWS = 16_384
QUERY_GROUP = 131_072
LEAF = 512
BLOCK = 1024
#: Entries kept beyond k + 1, so that rounding of products can't decide who is found.
SPARE = 8


class Tree:
    """A vantage-point tree over rows of ``vectors``, extended to norm ``longest`` (squared)."""

    def __init__(self, vectors: np.ndarray, longest: float, seed: int):
        self.vectors = vectors
        self.longest = longest
        rest = np.sqrt(np.maximum(longest - (vectors * vectors).sum(1), 0))
        self.extended = np.hstack([vectors, rest[:, None]])
        self.nodes: list = []
        self._draw = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray) -> int:
        place = len(self.nodes)
        self.nodes.append(None)
        if len(rows) <= LEAF:
            self.nodes[place] = (np.sort(rows), None)
            return place
        # of a few drawn vantage points the one whose distances spread most
        drawn = self._draw.choice(rows, min(5, len(rows)), replace=False)
        apart = np.sqrt(np.maximum(2 * self.longest - 2 * self.extended[drawn] @ self.extended[rows].T, 0))
        best = int(np.argmax(apart.std(axis=1)))
        apart = apart[best]
        order = np.argsort(apart, kind="stable")
        middle = len(rows) // 2
        halves = []
        for some in (order[:middle], order[middle:]):
            halves.append((self._build(rows[some]), float(apart[some].min()), float(apart[some].max())))
        self.nodes[place] = (int(drawn[best]), halves)
        return place

    def search(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        """The ``k`` best rows of each query found (-1: none), ties to the smaller row."""
        k = min(k, len(self.vectors))
        found = np.full((len(queries), k), -1)
        product = np.full((len(queries), k), -np.inf)
        norms = (queries * queries).sum(1)
        slack = 1e-7 * np.sqrt(norms + self.longest)
        apart = lambda who, p: np.sqrt(np.maximum((norms[who] + self.longest)[:, None] - 2 * p, 0))
        waiting = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while waiting:
            node, who, bound = waiting.pop()
            still = factor * bound <= apart(who, product[who, -1:])[:, 0] + slack[who]
            who = who[still]
            if not len(who):
                continue
            first, halves = self.nodes[node]
            if halves is None:
                near = queries[who] @ self.vectors[first].T
                some = (near >= product[who, -1:]).any(axis=1)
                who, near = who[some], near[some]
                if len(who):
                    product[who], found[who] = _best(
                        np.hstack([product[who], near]), np.hstack([found[who], np.broadcast_to(first, near.shape)]), k)
                continue
            ring = apart(who, (queries[who] @ self.vectors[first])[:, None])[:, 0]
            bounds = [np.maximum(np.maximum(low - ring, ring - high), 0) for _, low, high in halves]
            parent = bound[still]
            nearer_first = bounds[0] <= bounds[1]
            # the last pushed is searched first: each query takes the nearer half first
            for mask, order in ((~nearer_first, (0, 1)), (nearer_first, (1, 0))):
                if mask.any():
                    for h in order:
                        waiting.append((halves[h][0], who[mask], np.maximum(bounds[h], parent)[mask]))
        return found


def _best(product: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest products of each line, best first, ties to the smaller row."""
    least = -np.partition(-product, k - 1, axis=1)[:, k - 1 : k]
    most = int((product >= least).sum(axis=1).max())
    if most < product.shape[1]:
        some = np.argpartition(-product, most - 1, axis=1)[:, :most]
        product, rows = np.take_along_axis(product, some, 1), np.take_along_axis(rows, some, 1)
    order = np.lexsort((rows, -product))[:, :k]
    return np.take_along_axis(product, order, 1), np.take_along_axis(rows, order, 1)


def _search(batches: Iterator[pa.RecordBatch], k: int, factor: float, longest: float):
    """Rows sorted by (part, is_query): a shard's vectors, then the queries it answers."""
    def matrix(column) -> np.ndarray:
        values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    part, vectors, ids, tree = None, [], [], None

    def answer(queries: np.ndarray, query_ids: np.ndarray):
        at = tree.search(queries, k + 1 + SPARE, factor)
        row = np.repeat(np.arange(len(queries)), at.shape[1])
        at = at.ravel()
        some = at >= 0
        row, at = row[some], at[some]
        # the measure itself, on the original vectors; the products are exact, the sums in order
        score = np.zeros(len(at))
        for d in range(queries.shape[1]):
            score += queries[row, d] * tree.vectors[at, d]
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[row]), pa.array([ids[a] for a in at.tolist()], pa.list_(pa.int64())), pa.array(score)],
            names=["query_id", "ids", "score"])

    for batch in batches:
        at = batch.column("part").to_numpy(zero_copy_only=False)
        kind = batch.column("is_query").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind.astype(int)) != 0)) + 1
        for first, last in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if first == last:
                continue
            some = batch.slice(first, last - first)
            if at[first] != part:
                part, vectors, ids, tree = at[first], [], [], None
            if not kind[first]:
                vectors.append(matrix(some.column("vector")))
                ids += some.column("ids").to_pylist()
                continue
            if tree is None:
                if not vectors:
                    continue
                order = sorted(range(len(ids)), key=lambda k: ids[k][0])  # rows in order of ids
                ids = [ids[k] for k in order]
                tree = Tree(np.vstack(vectors)[order], longest, int(part) % 2**31)
            queries = matrix(some.column("vector"))
            query_ids = np.array([i[0] for i in some.column("ids").to_pylist()], np.int64)
            for begin in range(0, len(queries), BLOCK):
                yield answer(queries[begin : begin + BLOCK], query_ids[begin : begin + BLOCK])


def nearest(vectors: DataFrame, is_query, k: int = 20, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query but itself.

    ``vectors``: vec_id, embedding; ``is_query``: a condition on vec_id.
    """
    numbers = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = numbers.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0))
    widths = usable.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    width = widths.agg(F.max_by("width", F.struct("n", "width"))).first()[0]
    usable = usable.where(F.size("vector") == F.lit(width)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    usable = cut(usable.withColumn("norm", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))
    longest = usable.agg(F.coalesce(F.max("norm"), F.lit(0.0))).first()[0] * (1 + 1e-12)
    # k + 1 smallest ids of a class: Spark cuts each task's share to as many before the shuffle
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = usable.select("vector", "vec_id", smallest.alias("place")).where(F.col("place") <= k + 1)
    classes = cut(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = cut(usable.where(is_query(F.col("vec_id"))).select("vec_id", "vector"))
    shards, groups = -(-classes.count() // SHARD_ROWS), -(-queries.count() // QUERY_GROUP)
    if not shards or not groups:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = (F.col("shard") * groups + F.col("group")).cast("long").alias("part")
    base = classes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards))).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(part, F.lit(False).alias("is_query"), "ids", "vector")
    asked = queries.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(part, F.lit(True).alias("is_query"), F.array("vec_id").alias("ids"), "vector")
    found = (
        base.unionByName(asked).repartition(shards * groups, "part").sortWithinPartitions("part", "is_query")
        .mapInArrow(lambda b: _search(b, k, factor, longest), "query_id long, ids array<long>, score double")
        .select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
