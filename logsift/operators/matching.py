"""E1-E4 at scale: exact top-k by packed blocks, for sparse, dense or blended similarity.

Every query must be compared with every indexed incident, because incidents without a
shared term still rank (with similarity zero) when fewer than k overlap. Emitting those
pairs as rows would be quadratic, so both sides are packed: a row holds a block of some
thousand documents of one scope with their vectors as arrays. A stored index is a table of such rows.

The smaller side, if it is counted to fit ``BROADCAST_BYTES``, goes to every task, and the other is
read where it lies: no row of it is shuffled, and a task keeps k matches of each query over all
blocks it reads. An index that meets sent queries is read in as many tasks as the cores need, however many
partitions it has: every one of them returns k rows per query. Two larger sides meet in a Cartesian product of their partitions: a
task holds the packed query blocks of one partition and lets the index blocks of another pass, one at a
time. Of a pair of blocks Python gets numbers only; a block comes with its first pair in the task. The index is
cut no finer than the cores need, so queries are shuffled, and k rows per query leave a task, a few times at most.

In a block, terms of many documents are columns of a dense matrix and go through one matrix
product; the others go through postings. Index texts that are identical are cut to k
copies beforehand, which cannot change a top-k.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from logsift.operators.ordering import top_per_group
from logsift.session import cut_lineage

# Scores equal to this many decimals are ties; the later document wins a tie.
TIE_DECIMALS = 9
# Packed queries, or a packed index, up to this size are sent to every task.
BROADCAST_BYTES = 32 << 20
# Queries of up to this size are sent even if the index is smaller: a stored one is read where it lies.
FEW_BYTES = 1 << 20
# Of two larger sides: packed queries that a task holds, and the least of the index that passes them.
HELD_BYTES = 16 << 20
PASSING_BYTES = 8 << 20
# Unpacked blocks of a sent or held side that a task keeps; the others are unpacked again for each block that they meet.
UNPACKED_BYTES = 64 << 20
# Documents, and term weights and vector components, of a block.
BLOCK_ROWS = 4_000
BLOCK_ENTRIES = 500_000
# A term in this share of a block's documents, or more, is a column of the dense matrix.
HOT_SHARE = 0.04
_CELLS = 250_000  # scores held at once by a task
_PAIRS = 250_000  # term pairs expanded at once by a task
_HOT_CELLS = 8_000_000  # dense weights of a block, at most


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


# ---- packing ------------------------------------------------------------------------------
def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _dense(column: pa.Array) -> np.ndarray:
    """Matrix of the vectors, one row per document; a document without a vector is zero."""
    present = np.asarray(column.is_valid())
    known = column.drop_null()
    widths = pc.unique(pc.list_value_length(known)).to_pylist()
    if len(widths) > 1:
        raise ValueError(f"Vectors differ in length: {sorted(widths)}.")
    matrix = np.zeros((len(column), widths[0] if widths else 0))
    if widths:
        matrix[present] = np.asarray(known.flatten(), dtype=np.float64).reshape(len(known), -1)
    return matrix


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _payload(table: pa.Table, id_column: str) -> bytes:
    """A block as one Arrow message. Postings run by term; a weight is the number of one of the block's distinct ones."""
    ids, indexed = _one(table[id_column]), "doc_pos" in table.column_names
    n = len(ids)
    order = np.arange(n)
    parts: dict[str, pa.Array] = {}
    if indexed:
        position = np.asarray(_one(table["doc_pos"]), dtype=np.int64)
        order = np.argsort(-position, kind="stable")  # later documents first: the earlier column wins a tie
        parts["position"] = pa.array(position[order])
    parts["id"] = ids.take(pa.array(order))
    if "term_ids" in table.column_names:
        terms = _one(table["term_ids"]).take(pa.array(order))
        weights = _one(table["weights"]).take(pa.array(order))
        sizes = np.asarray(pc.fill_null(pc.list_value_length(terms), 0), dtype=np.int64)
        row = np.repeat(np.arange(n), sizes)
        term, weight = (np.asarray(c.flatten(), dtype=kind) for c, kind in ((terms, np.int64), (weights, np.float64)))
        length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=n))
        by_term = np.argsort(term, kind="stable")
        known, counts = np.unique(term, return_counts=True)
        values, code = np.unique(weight[by_term], return_inverse=True)
        parts |= {"row": pa.array(_narrow(row[by_term])), "code": pa.array(_narrow(code)), "term": pa.array(known), "count": pa.array(_narrow(counts)),
                  "value": pa.array(values), "length": pa.array(np.where(length > 0, length, 1.0))}
    if "embedding" in table.column_names:
        parts["vector"] = pa.array(_dense(_one(table["embedding"]).take(pa.array(order))).ravel())
    # lists of one row: arrays of different lengths in one message
    batch = pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in parts.values()], names=list(parts))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _packer(id_column: str, scope: tuple[str, ...], most_rows: int, most_entries: int):
    """Consecutive rows of one scope as blocks of bounded size."""
    def entries(table: pa.Table) -> np.ndarray:
        size = np.ones(table.num_rows, np.int64)
        for name in ("term_ids", "embedding"):
            if name in table.column_names:
                size += np.asarray(pc.fill_null(pc.list_value_length(_one(table[name])), 0), dtype=np.int64)
        return size

    def pack(batches: Iterator[pa.RecordBatch]):
        held: list[pa.Table] = []
        current, rows, size, kinds = None, 0, 0, None

        def done():
            table = pa.concat_tables(held)
            payload = _payload(table, id_column)
            values = [pa.array([v], kinds.field(c).type) for c, v in zip(scope, current)]
            block = int.from_bytes(hashlib.blake2b(payload + repr(current).encode(), digest_size=8).digest(), "little", signed=True)
            return pa.RecordBatch.from_arrays(
                [*values, pa.array([block]), _one(table[id_column]).slice(0, 1), pa.array([table.num_rows]), pa.array([len(payload)]),
                 pa.array([payload], pa.binary())], names=[*scope, "block", "first_id", "rows", "bytes", "payload"])

        for batch in batches:
            table, kinds = pa.Table.from_batches([batch]), batch.schema
            keys = list(zip(*[table[c].to_pylist() for c in scope])) if scope else [()] * table.num_rows
            sizes, first = entries(table), 0
            for at in range(table.num_rows):
                full = rows == most_rows or size + sizes[at] > most_entries
                if rows and (full or keys[at] != current):
                    if at > first:
                        held.append(table.slice(first, at - first))
                    yield done()
                    held, rows, size, first = [], 0, 0, at
                current, rows, size = keys[at], rows + 1, size + int(sizes[at])
            if table.num_rows > first:
                held.append(table.slice(first))
        if rows:
            yield done()
    return pack


def pack_blocks(rows: DataFrame, id_column: str, scope: Sequence[str] = (), most_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vector_rows`` as blocks: (scope..., block, first_id, rows, bytes, payload). Rows stay in their partitions.

    ``block`` is a number of its own, from a digest of the block and its scope.
    """
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in scope)
    placed = rows.sortWithinPartitions(*scope) if scope else rows
    kinds += f"block long, first_id {rows.schema[id_column].dataType.simpleString()}, rows long, bytes long, payload binary"
    return placed.mapInArrow(_packer(id_column, tuple(scope), most_rows, BLOCK_ENTRIES), kinds)


# ---- matching -----------------------------------------------------------------------------
class _Block:
    """The arrays of a payload; postings run by term (``start``), those of queries by row."""

    def __init__(self, payload: bytes) -> None:
        batch = pa.ipc.open_stream(payload).read_next_batch()
        parts = {name: batch.column(name).flatten() for name in batch.schema.names}
        self.ids = parts["id"]
        self.n = len(self.ids)
        get = lambda name: parts[name].to_numpy(zero_copy_only=False) if name in parts else None
        self.position, self.row, self.term, vector = map(get, ("position", "row", "term", "vector"))
        if self.term is not None:
            self.weight = get("value")[get("code")] / get("length")[self.row]
            counts = get("count").astype(np.int64)
            self.start = np.append(0, np.cumsum(counts))
            if self.position is None:
                order = np.argsort(self.row, kind="stable")
                self.row, self.term, self.weight = self.row[order].astype(np.int64), np.repeat(self.term, counts)[order], self.weight[order]
        self.vectors = vector.reshape(self.n, -1) if vector is not None and len(vector) else np.zeros((self.n, 0))


class _Postings:
    """Inverted index of a block, its frequent terms as a dense matrix."""

    def __init__(self, block: _Block) -> None:
        self.n, self.terms, self.docs, self.weights = block.n, block.term, block.row, block.weight
        self.starts, self.counts = block.start[:-1], np.diff(block.start)
        hot = np.flatnonzero(self.counts >= max(8, HOT_SHARE * self.n))
        hot = hot[np.argsort(-self.counts[hot], kind="stable")][: _HOT_CELLS // max(1, self.n)]
        self.column = np.full(len(self.terms), -1)
        self.column[hot] = np.arange(len(hot))
        self.dense = np.zeros((len(hot), self.n))
        at = _spans(self.starts[hot], self.counts[hot])
        self.dense[np.repeat(np.arange(len(hot)), self.counts[hot]), self.docs[at]] = self.weights[at]

    def scores(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """Dot products of ``n`` query rows given as (row, term, weight) triples."""
        if not len(self.terms) or not len(terms):
            return np.zeros((n, self.n))
        slot = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[slot] == terms
        rows, weights, slot = rows[known], weights[known], slot[known]
        column = self.column[slot]
        hot = column >= 0
        asked = np.zeros((n, len(self.dense)))
        asked[rows[hot], column[hot]] = weights[hot]
        result = (asked @ self.dense).ravel()
        rows, weights, slot = rows[~hot], weights[~hot], slot[~hot]
        lengths = self.counts[slot]
        step = np.cumsum(lengths) // _PAIRS
        for part in range(int(step[-1]) + 1 if len(step) else 0):
            lo, hi = np.searchsorted(step, [part, part + 1])
            span = _spans(self.starts[slot[lo:hi]], lengths[lo:hi])
            cell = np.repeat(rows[lo:hi].astype(np.int64) * self.n, lengths[lo:hi]) + self.docs[span]
            value = np.repeat(weights[lo:hi], lengths[lo:hi]) * self.weights[span]
            result += np.bincount(cell, weights=value, minlength=len(result))
        return result.reshape(n, self.n)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best cells per row; earlier columns win ties."""
    rounded = np.round(scores, TIE_DECIMALS)
    n, width = rounded.shape
    if width <= k:
        columns = np.argsort(-rounded, axis=1, kind="stable")
        return np.repeat(np.arange(n), width), columns.ravel()
    cutoff = np.partition(rounded, width - k, axis=1)[:, width - k]
    rows, columns = np.nonzero(rounded >= cutoff[:, None])
    values = rounded[rows, columns]
    order = np.lexsort((columns, -values, rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(n))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], columns[keep]


_FOUND = ("row", "semantic_weight", "doc_id", "doc_pos", "score", "semantic", "lexical")


class _Matcher:
    """Matches of one block of queries over the index blocks that a task sees."""

    def __init__(self, k: int, weights: tuple[float, ...]) -> None:
        self.k, self.weights = k, weights
        self.found: pa.Table | None = None

    def add(self, asked: _Block, block: _Block, postings: _Postings | None) -> None:
        """Keep the k best of what was found before and the matches of a block."""
        if self.found is None:
            self.ids = asked.ids.take(pa.array(np.arange(asked.n)))  # without the rest of the message
            # the k-th best score of a query so far, which a match has to reach
            self.least = np.full((len(self.weights), asked.n), -np.inf)
        parts = []
        dense = any(w > 0.0 for w in self.weights) and asked.vectors.shape[1] and block.vectors.shape[1]
        if dense and asked.vectors.shape[1] != block.vectors.shape[1]:
            raise ValueError(f"Vectors differ in length: {sorted((asked.vectors.shape[1], block.vectors.shape[1]))}.")
        step = max(1, _CELLS // max(1, block.n))
        if postings is not None:
            step = max(1, min(step, _HOT_CELLS // max(1, len(postings.dense))))
        for lo in range(0, asked.n, step):
            hi = min(lo + step, asked.n)
            semantic = lexical = np.zeros((hi - lo, block.n))
            if postings is not None and asked.row is not None:
                a, b = np.searchsorted(asked.row, [lo, hi])
                lexical = postings.scores(asked.row[a:b] - lo, asked.term[a:b], asked.weight[a:b], hi - lo)
            if dense:
                semantic = asked.vectors[lo:hi] @ block.vectors.T
            for at, weight in enumerate(self.weights):
                blended = lexical if weight == 0.0 else semantic if weight == 1.0 else weight * semantic + (1.0 - weight) * lexical
                reached = blended >= (self.least[at, lo:hi] - 2 * 10.0 ** -TIE_DECIMALS)[:, None]
                if np.count_nonzero(reached) <= 2 * self.k * (hi - lo):
                    rows, columns = np.divmod(np.flatnonzero(reached), block.n)
                else:
                    rows, columns = _best(blended, self.k)
                if len(rows):
                    parts.append(pa.table([
                        pa.array(rows + lo), pa.array(np.full(len(rows), weight)), block.ids.take(pa.array(columns)), pa.array(block.position[columns]),
                        pa.array(blended[rows, columns]), pa.array(semantic[rows, columns]), pa.array(lexical[rows, columns])], names=list(_FOUND)))
        if not parts:
            return
        table = pa.concat_tables(parts if self.found is None else [self.found, *parts])
        row, weight, position, score = (table[c].to_numpy() for c in ("row", "semantic_weight", "doc_pos", "score"))
        score = np.round(score, TIE_DECIMALS)
        order = np.lexsort((-position, -score, weight, row))
        new = np.append(True, (np.diff(row[order]) != 0) | (np.diff(weight[order]) != 0))
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        last = order[place == self.k - 1]
        for at, w in enumerate(self.weights):
            own = last[weight[last] == w]
            self.least[at, row[own]] = score[own]
        self.found = table.take(pa.array(order[place < self.k])).combine_chunks()

    def result(self, names: Sequence[str], values: tuple, kinds: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
        if self.found is None:
            return
        n = self.found.num_rows
        rows = self.found.column("row").combine_chunks()
        columns = [pa.array([v] * n, kind) for v, kind in zip(values, kinds)]
        table = pa.table([*columns, self.ids.take(rows), *[self.found[c] for c in _FOUND[1:]]], names=[*names, "query_id", *_FOUND[1:]])
        yield from table.to_batches()


def _sparse(weights: tuple[float, ...], block: _Block) -> _Postings | None:
    return _Postings(block) if block.term is not None and any(w < 1.0 for w in weights) else None


def _memory(block: _Block, postings: _Postings | None) -> int:
    """Bytes of the arrays of an unpacked block."""
    arrays = [a for part in (block, postings) if part is not None for a in vars(part).values() if isinstance(a, np.ndarray)]
    return sum(a.nbytes for a in {id(a): a for a in arrays}.values())


class _Unpacked:
    """Blocks of a sent or held side: up to UNPACKED_BYTES of their arrays are kept, the others are unpacked for each use."""

    def __init__(self, unpack) -> None:
        self.unpack, self.free = unpack, UNPACKED_BYTES
        self.kept: dict[tuple, tuple[_Block, _Postings | None]] = {}

    def get(self, key: tuple, payload: bytes) -> tuple[_Block, _Postings | None]:
        if key in self.kept:
            return self.kept[key]
        both = self.unpack(payload)
        size = _memory(*both)
        if size <= self.free:
            self.kept[key], self.free = both, self.free - size
        return both


def _against_queries(queries, k: int, weights: tuple[float, ...], scope: tuple[str, ...]):
    """Index blocks as they are read against all query blocks of their scope."""
    def work(batches: Iterator[pa.RecordBatch]):
        matchers: dict[tuple, list[_Matcher]] = {}
        unpacked = _Unpacked(lambda payload: (_Block(payload), None))
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in scope]
            for at in range(batch.num_rows):
                key = tuple(batch.column(c)[at].as_py() for c in scope)
                if key not in queries.value:
                    continue
                some = matchers.setdefault(key, [_Matcher(k, weights) for _ in queries.value[key]])
                block = _Block(batch.column("payload")[at].as_py())
                postings = _sparse(weights, block)
                for number, (payload, matcher) in enumerate(zip(queries.value[key], some)):
                    matcher.add(unpacked.get((key, number), payload)[0], block, postings)
        unpacked.kept.clear()
        for key, some in matchers.items():
            for matcher in some:
                yield from matcher.result(scope, key, kinds)
    return work


def _against_index(index, k: int, weights: tuple[float, ...], scope: tuple[str, ...]):
    """Query blocks as they are read against all index blocks of their scope."""
    def unpack(payload: bytes) -> tuple[_Block, _Postings | None]:
        block = _Block(payload)
        return block, _sparse(weights, block)

    def work(batches: Iterator[pa.RecordBatch]):
        unpacked = _Unpacked(unpack)
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in scope]
            for at in range(batch.num_rows):
                key = tuple(batch.column(c)[at].as_py() for c in scope)
                if key not in index.value:
                    continue
                asked, matcher = _Block(batch.column("payload")[at].as_py()), _Matcher(k, weights)
                for number, payload in enumerate(index.value[key]):
                    matcher.add(asked, *unpacked.get((key, number), payload))
                yield from matcher.result(scope, key, kinds)
    return work


def _in_cell(k: int, weights: tuple[float, ...], scope: tuple[str, ...]):
    """Pairs of an index block and a query block, all queries of the task for one index block after the other.

    A query block comes with the task's first index block, an index block with the task's first query block.
    """
    def work(batches: Iterator[pa.RecordBatch]):
        asked: dict[int, tuple[tuple, bytes]] = {}
        matchers: dict[int, _Matcher] = {}
        unpacked = _Unpacked(lambda payload: (_Block(payload), None))
        held, payload, block, postings, kinds = None, b"", None, None, []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in scope]
            for at in range(batch.num_rows):
                get = lambda name: batch.column(name)[at].as_py()  # noqa: B023, E731
                number, asking = get("_index"), get("_query")
                if (sent := get("_asked")) is not None:
                    asked[asking] = tuple(get(f"_of_{c}") for c in scope), sent
                if (sent := get("payload")) is not None:
                    held, payload, block, postings = number, sent, None, None
                if number != held or asking not in asked:
                    raise RuntimeError("A pair came before its blocks.")
                key, queries = asked[asking]
                if key != tuple(get(c) for c in scope):
                    continue
                if block is None:
                    block = _Block(payload)
                    postings = _sparse(weights, block)
                matchers.setdefault(asking, _Matcher(k, weights)).add(unpacked.get((asking,), queries)[0], block, postings)
        unpacked.kept.clear()
        for asking, matcher in matchers.items():
            yield from matcher.result(scope, asked[asking][0], kinds)
    return work


def _in_cells(queries: DataFrame, index: DataFrame, scope: tuple[str, ...], asked: int, indexed: int) -> DataFrame:
    """Every index block beside every query block; ``asked`` and ``indexed`` are the bytes of the sides."""
    parts = -(-asked // HELD_BYTES)
    # queries are read again for each part of the index: no more parts than give every core two tasks
    passing = min(-(-indexed // PASSING_BYTES), -(-2 * queries.sparkSession.sparkContext.defaultParallelism // parts))
    # numbered inside a task: equal blocks stay two
    left = index.select(*scope, "payload").coalesce(passing).withColumn("_index", F.monotonically_increasing_id())
    right = queries.select(*[F.col(c).alias(f"_of_{c}") for c in scope], "block", F.col("payload").alias("_asked")).repartition(parts, "block").drop(
        "block").withColumn("_query", F.monotonically_increasing_id())
    first = lambda number: F.col(number).bitwiseAND(F.lit((1 << 33) - 1)) == 0  # noqa: E731 (the row number inside a task)
    return left.crossJoin(right.hint("shuffle_replicate_nl")).select(
        *scope, "_index", F.when(first("_query"), F.col("payload")).alias("payload"),
        *[f"_of_{c}" for c in scope], "_query", F.when(first("_index"), F.col("_asked")).alias("_asked"))


def _packed_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("bytes")).first()[0] or 0


def _by_scope(blocks: DataFrame, scope: tuple[str, ...]) -> dict[tuple, list[bytes]]:
    """Payloads of a side of at most BROADCAST_BYTES."""
    found: dict[tuple, list[bytes]] = {}
    for row in blocks.select(*scope, "payload").collect():
        found.setdefault(tuple(row[c] for c in scope), []).append(bytes(row["payload"]))
    return found


def match_blocks(
    queries: DataFrame, index: DataFrame, k: int, *, semantic_weights: Sequence[float] = (0.0,), scope: Sequence[str] = (),
) -> DataFrame:
    """Top-k documents of each query and weight from packed blocks; rank 1 is best, ties go to later documents.

    ``queries`` is kept once (its size decides how it travels).
    """
    weights, scope = tuple(float(w) for w in semantic_weights), tuple(scope)
    if any(not 0.0 <= w <= 1.0 for w in weights):
        raise ValueError("semantic_weight must be between 0 and 1.")
    context = queries.sparkSession.sparkContext
    kinds = "".join(f"{c} {index.schema[c].dataType.simpleString()}, " for c in scope)
    query_id, doc_id = (df.schema["first_id"].dataType.simpleString() for df in (queries, index))
    schema = kinds + (
        f"query_id {query_id}, semantic_weight double, doc_id {doc_id}, doc_pos bigint, score double, semantic double, lexical double")
    queries = cut_lineage(queries)
    asked, indexed = _packed_bytes(queries), _packed_bytes(index)
    if asked <= min(max(indexed, FEW_BYTES), BROADCAST_BYTES):
        work = _against_queries(context.broadcast(_by_scope(queries, scope)), k, weights, scope)
        blocks, tasks = index.select(*scope, "payload"), 2 * context.defaultParallelism
        found = (blocks.coalesce(tasks) if blocks.rdd.getNumPartitions() > tasks else blocks).mapInArrow(work, schema)
    elif indexed <= BROADCAST_BYTES:
        work = _against_index(context.broadcast(_by_scope(index, scope)), k, weights, scope)
        found = queries.select(*scope, "payload").mapInArrow(work, schema)
    else:
        found = _in_cells(queries, index, scope, asked, indexed).mapInArrow(_in_cell(k, weights, scope), schema)
    return top_per_group(
        found, [*scope, "query_id", "semantic_weight"], [F.desc(F.round("score", TIE_DECIMALS)), F.desc("doc_pos")], k)


def top_matches(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    *,
    semantic_weights: Sequence[float] = (0.0,),
    scope: Sequence[str] = (),
    query_blocks: int | None = None,
    index_blocks: int | None = None,
) -> DataFrame:
    """Top-k documents of each query and weight, both sides as ``vector_rows``.

    The index side has doc_pos: unique, chronological. A query meets documents of its own
    scope only; ids may repeat between scopes, so the scope's columns come back with every match.
    ``query_blocks`` and ``index_blocks`` deal a side out to that many partitions first.
    """
    sides = []
    for df, column, number in ((queries, "query_id", query_blocks), (index, "doc_id", index_blocks)):
        placed = df if number is None else df.repartition(number, *scope, column)
        sides.append(pack_blocks(placed, column, scope))
    return match_blocks(*sides, k, semantic_weights=semantic_weights, scope=scope)


def reduce_copies(index: DataFrame, k: int, content: Sequence[str], scope: Sequence[str] = ()):
    """Keep the k latest documents of each identical content; exact for top-k results."""
    hashed = index.withColumn(
        "_content", F.sha2(F.to_json(F.struct(*content)), 256)
    )
    return top_per_group(
        hashed, [*scope, "_content"], [F.desc("doc_pos")], k, "_copy"
    ).drop("_content", "_copy")
