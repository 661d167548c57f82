"""Hard negatives: rows of another label that score close below an anchor's positives.

Pair scores travel as packed keys (anchor, descending score, kind, id) whose bytes sort in
that order: ``repartition`` by anchor and ``sortWithinPartitions`` by key are the
secondary-sort shuffle (Spark's repartitionAndSortWithinPartitions on DataFrames). One
iterator reads a task's keys in order. It opens a window at each positive, emits a negative
to every window it falls into, and closes windows that are full, so no anchor's rows are ever held.

Anchors meet all rows in blocks of bounded size: a task scores an anchor block against a
row block by matrix products, twice. The first time it sends each anchor's best positives
of the block; they go through the shuffle and give the anchor's windows. The second time it
sends, for each window, the best negatives of the block that lie in it, so an anchor's keys
grow with the number of blocks and not with the number of rows.

Components become floor(256 * x); scores are whole numbers and exact: products below 2^53
use floats, larger ones Python's integers. A score beyond a long counts as the nearest long.

Rows with a null label, a null or empty vector or a null or non-finite component take no
part, nor do rows without vec_id. Rows of one id count once (the smallest label, then the
smallest vector). Vectors meet vectors of their own length only. Equal scores are ordered
by vec_id. Without rows or anchors the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsift.llm.shared import cut

#: Components of a row block and of an anchor block.
ROW_BLOCK = 1 << 19
ANCHOR_BLOCK = 1 << 18
#: Scores that a task holds at once.
CELLS = 1 << 20

_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_POSITIVE, _NEGATIVE = 0, 1
_LONG = (1 << 63) - 1
_FLIP = np.uint64(1 << 63)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the longs."""
    return np.asarray(values, np.int64).view(np.uint64) ^ _FLIP


def packed_keys(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys whose bytes ascend with anchor, descending score, kind and id."""
    keys = np.zeros(len(anchor), _KEY)
    keys["anchor"], keys["score"], keys["kind"], keys["id"] = _ordered(anchor), ~_ordered(score), kind, _ordered(ids)
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * _KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])


def unpacked_keys(column: pa.Array) -> tuple[list, list, list, list]:
    """Anchors, scores, kinds and ids of packed keys."""
    keys = np.frombuffer(b"".join(column.to_pylist()), _KEY)
    long = lambda x: (x.astype(np.uint64) ^ _FLIP).view(np.int64).tolist()
    return long(keys["anchor"]), long(~keys["score"].astype(np.uint64)), keys["kind"].tolist(), long(keys["id"])


def whole_numbers(vectors: pa.ChunkedArray) -> np.ndarray:
    """floor(256 * x) of all components, as floats if they hold them and else as integers."""
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]).reshape(len(vectors), -1)
    if np.abs(x).max(initial=0) < 2.0**44:
        return np.floor(x * 256)
    return np.array([[math.floor(256 * int(v)) if abs(v) >= 2.0**60 else math.floor(256 * v) for v in row] for row in x.tolist()], object)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as exact whole numbers: floats below 2^53 (also times 100), or objects."""
    if anchors.dtype != object and rows.dtype != object:
        most = np.abs(anchors).sum(1).max(initial=0) * np.abs(rows).max(initial=0)
        if 100 * most < 2.0**53:
            return anchors @ rows.T
    exact = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(exact(anchors) @ exact(rows).T, -_LONG - 1, _LONG)


def _first(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and column of each line's ``k`` largest allowed scores; ties go to the earlier column."""
    if score.dtype == object:
        lines, columns = [], []
        for line in range(len(score)):
            best = sorted(np.flatnonzero(allowed[line]).tolist(), key=lambda c: (-score[line, c], c))[:k]
            lines += [line] * len(best)
            columns += best
        return np.array(lines, np.int64), np.array(columns, np.int64)
    masked = np.where(allowed, score, -np.inf)
    if masked.shape[1] > k:
        least = -np.partition(-masked, k - 1, axis=1)[:, k - 1 : k]
        allowed = allowed & (masked >= least)
    line, column = np.nonzero(allowed)
    order = np.lexsort((column, -score[line, column], line))
    line, column = line[order], column[order]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    return line[place < k], column[place < k]


def _score_block(positives: int, negatives: int, low: int, high: int):
    """A cogroup's work: keys of positives, or, for anchors with windows, of negatives."""
    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[pa.Array] = []
        if anchors.num_rows and rows.num_rows:
            ids = rows["row_id"].to_numpy()
            by_id = np.argsort(ids)
            ids, labels = ids[by_id], rows["row_label"].to_numpy()[by_id]
            matrix = whole_numbers(rows["row_vector"])[by_id]
            step = max(1, CELLS // len(ids))
            for first in range(0, anchors.num_rows, step):
                some = anchors.slice(first, step)
                own, label = some["anchor_id"].to_numpy(), some["anchor_label"].to_numpy()
                score = scores(whole_numbers(some["anchor_vector"]), matrix)
                same = label[:, None] == labels[None, :]
                if "windows" not in some.column_names:
                    line, column = _first(score, same & (own[:, None] != ids[None, :]), positives)
                    out.append(packed_keys(own[line], score[line, column].astype(np.int64), _POSITIVE, ids[column]))
                    continue
                windows = some["windows"].to_pylist()
                chosen = np.zeros(score.shape, bool)
                for k in range(max(map(len, windows), default=0)):
                    p = [w[k] if k < len(w) else None for w in windows]
                    has = np.array([v is not None for v in p])
                    value = np.array([v or 0 for v in p], object if score.dtype == object else np.float64)[:, None]
                    inside = ~same & has[:, None] & (low * value <= 100 * score).astype(bool) & (100 * score <= high * value).astype(bool)
                    chosen[_first(score, inside, negatives)] = True
                line, column = np.nonzero(chosen)
                out.append(packed_keys(own[line], score[line, column].astype(np.int64), _NEGATIVE, ids[column]))
        return pa.table({"key": pa.chunked_array(out, pa.binary())})
    return work


def secondary_sorted(keys: DataFrame) -> DataFrame:
    """Keys dealt out by anchor and sorted inside every partition."""
    return keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")


def _windows(batches: Iterator[pa.RecordBatch], positives: int):
    """The first positives of every anchor, in order: (anchor, positive, score)."""
    current, seen = None, 0
    for batch in batches:
        out = []
        for anchor, score, _, row in zip(*unpacked_keys(batch.column("key"))):
            if anchor != current:
                current, seen = anchor, 0
            if seen < positives:
                out.append((anchor, row, score))
                seen += 1
        yield _columns(out, ("anchor_id", "positive_id", "positive_score"))


def _columns(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = [pa.int32() if n == "rank" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=list(names))


_MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _emitted(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, low: int, high: int):
    """Reads keys in order: positives open windows, negatives are emitted to those that hold them."""
    current, opened, seen = None, [], 0
    for batch in batches:
        out = []
        for anchor, score, kind, row in zip(*unpacked_keys(batch.column("key"))):
            if anchor != current:
                current, opened, seen = anchor, [], 0
            if kind == _POSITIVE:
                if seen < positives:
                    opened.append([row, score, 0])
                    seen += 1
                continue
            closed = False
            for window in opened:
                positive, value, given = window
                # scores fall: below the lower edge a window gets nothing any more
                if given == negatives or 100 * score < low * value:
                    closed = True
                elif 100 * score <= high * value:
                    window[2] = given + 1
                    out.append((anchor, positive, given + 1, row, value, score))
            if closed:
                opened = [w for w in opened if w[2] < negatives and 100 * score >= low * w[1]]
        yield _columns(out, _MINED)


def usable_rows(vectors: DataFrame) -> DataFrame:
    """row_id, row_label, row_vector of the rows that take part, one for each id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("row_id"), F.col("label").cast("long").alias("row_label"),
                          F.col("embedding").cast("array<double>").alias("row_vector"))
    finite = F.forall("row_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("row_id IS NOT NULL AND row_label IS NOT NULL AND row_vector IS NOT NULL").where(finite & (F.size("row_vector") > 0))
    least = F.min(F.struct("row_label", "row_vector")).alias("least")
    return rows.groupBy("row_id").agg(least).select("row_id", "least.*")


def hard_negatives(
    vectors: DataFrame,
    is_anchor,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, embedding, label. ``is_anchor``: a condition on vec_id. ``label``
    replaces the label (an expression over the columns of ``vectors``; null leaves a row out). A
    negative belongs to a positive if ``low`` * p <= 100 * n <= ``high`` * p, for 0 < high < 100.
    """
    if not 0 < low <= high < 100:
        raise ValueError("0 < low <= high < 100 is needed: a window lies below its positive.")
    if label is not None:
        vectors = vectors.withColumn("label", label)
    rows = cut(usable_rows(vectors.select("vec_id", "label", "embedding")).withColumn("width", F.size("row_vector")))
    anchors = cut(rows.where(is_anchor(F.col("row_id"))).select(
        *[F.col(f"row_{c}").alias(f"anchor_{c}") for c in ("id", "label", "vector")], "width"))

    def blocks(df: DataFrame, most: int) -> int:
        return max(1, -(-(df.agg(F.sum("width")).first()[0] or 0) // most))

    row_blocks, anchor_blocks = blocks(rows, ROW_BLOCK), blocks(anchors, ANCHOR_BLOCK)
    keys = ["width", "pair"]

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    right = rows.withColumn("other", every(anchor_blocks)).withColumn(
        "pair", F.col("other") * row_blocks + F.pmod(F.xxhash64("row_id"), F.lit(row_blocks))).drop("other")

    def scored(asked: DataFrame) -> DataFrame:
        left = asked.withColumn("other", every(row_blocks)).withColumn(
            "pair", F.pmod(F.xxhash64("anchor_id"), F.lit(anchor_blocks)) * row_blocks + F.col("other")).drop("other")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_score_block(positives, negatives, low, high), "key binary")

    found = cut(secondary_sorted(scored(anchors)).mapInArrow(
        lambda b: _windows(b, positives), "anchor_id long, positive_id long, positive_score long"))
    windows = found.groupBy("anchor_id").agg(F.collect_list("positive_score").alias("windows"))  # at most ``positives``
    opening = found.mapInArrow(_positive_keys, "key binary")
    inside = scored(anchors.join(windows, "anchor_id"))
    return secondary_sorted(opening.unionByName(inside)).mapInArrow(
        lambda b: _emitted(b, positives, negatives, low, high),
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _positive_keys(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        anchor, row, score = (batch.column(c).to_numpy() for c in ("anchor_id", "positive_id", "positive_score"))
        yield pa.RecordBatch.from_arrays([packed_keys(anchor, score, _POSITIVE, row)], names=["key"])
