"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Tokens are runs of letters (A-Z in lower case) and runs of other signs, known by 64 bits of
hash. Every token has a fixed sparse index vector, drawn from its hash, and a word vector of
its own: the sum, over the whole corpus, of the index vectors of the tokens up to ``REACH``
places away in the same text, less the corpus mean and scaled to unit length. A document is
the mean of its tokens' vectors.

Tasks add up the contexts of ``MOST_HELD`` tokens at a time, in place, and send sums of whole numbers
in compressed blobs, which meet again in buckets of tokens: the table of vectors grows with the vocabulary and lies in the shared
folder. The ``COMMON`` most frequent vectors are broadcast. What a text has of other tokens is
counted by text and token and joined with the table, so no token is left out or shares
another's vector; only how a vector is reached depends on its frequency.

The network is fitted with NumPy on at most ``MOST_LABELLED`` labelled documents (those
with the smallest hash of their id); this is the one bound, and only labels that
``may_learn`` admits are read. A fifth of them chooses the temperature that the scores are
divided by. Without labels of both kinds every score is the share of good labels (0.5
without any).

An empty or null text pools to a zero vector and gets the network's score for it. Repeated
rows are scored as they come; several labels of one id are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from logsift.llm import textbytes as T
from logsift.llm.shared import BROADCAST_BYTES, checked_broadcast, cut, discard

DIMENSIONS = 32
NONZERO = 4
REACH = 2
MOST_LABELLED = 20_000
HIDDEN = 16
#: Frequent tokens whose vectors every worker has; the others are joined.
COMMON = 1 << 18
#: Distinct tokens whose contexts a task adds up before it sends them.
MOST_HELD = 1 << 18
#: Bytes of text for each bucket in which the tasks' sums meet.
BUCKET_BYTES = 4 << 20
#: Copied texts whose keys (64 bytes each) every task gets, at most.
MOST_COPIED = BROADCAST_BYTES // 64
_TOKENS = 1 << 16

#: Bytes by class: 0 separates, letters and digits and non-ASCII 1, other signs 2.
_KINDS = T.LETTERS.astype(np.uint8)
_KINDS[(_KINDS == 0) & T.NOT_SPACE] = 2


_SUMS_SQL = "token long, n long, vector binary"


def index_vectors(token: np.ndarray) -> np.ndarray:
    """One row for each token hash: ``NONZERO`` different places with 1 or -1."""
    vectors = np.zeros((len(token), DIMENSIONS), np.int8)
    rows = np.arange(len(token))
    drawn = T.mix(token ^ np.uint64(0x51ED270B7A4F4C15))
    for k in range(NONZERO):  # the first free place from a drawn one
        place = ((drawn >> np.uint64(8 * k)) % np.uint64(DIMENSIONS)).astype(np.int64)
        while (taken := vectors[rows, place] != 0).any():
            place = np.where(taken, (place + 1) % DIMENSIONS, place)
        vectors[rows, place] = np.where((drawn >> np.uint64(40 + k)) & np.uint64(1), 1, -1)
    return vectors


def _rows(token: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Tokens, their number and their sums as bytes of the smallest whole numbers that hold them."""
    most = np.abs(sums).max(1, initial=0)
    packed = np.empty(len(sums), object)
    at = np.flatnonzero(most <= 7)  # two to a byte
    low = sums[at].astype(np.uint8) & 15
    raw, size = (low[:, ::2] | (low[:, 1::2] << 4)).tobytes(), DIMENSIONS // 2
    packed[at] = [raw[k : k + size] for k in range(0, len(raw), size)]
    low = 8
    for bits, kind in ((7, np.int8), (15, np.int16), (31, np.int32), (63, np.int64)):
        high = (1 << bits) - 1
        at = np.flatnonzero((most >= low) & (most <= high))
        raw, size = sums[at].astype(kind).tobytes(), DIMENSIONS * np.dtype(kind).itemsize
        packed[at] = [raw[k : k + size] for k in range(0, len(raw), size)]
        low = high + 1
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n), pa.array(packed.tolist(), pa.binary())], names=["token", "n", "vector"])


def _wide(packed: list[bytes]) -> np.ndarray:
    out = np.zeros((len(packed), DIMENSIONS), np.int64)
    sizes = np.array([len(p) for p in packed])
    at = np.flatnonzero(sizes == DIMENSIONS // 2)
    raw = np.frombuffer(b"".join([packed[k] for k in at.tolist()]), np.uint8).reshape(-1, DIMENSIONS // 2)
    out[at, ::2], out[at, 1::2] = ((raw & 15) ^ 8).astype(np.int64) - 8, ((raw >> 4) ^ 8).astype(np.int64) - 8
    for kind in (np.int8, np.int16, np.int32, np.int64):
        at = np.flatnonzero(sizes == DIMENSIONS * np.dtype(kind).itemsize)
        out[at] = np.frombuffer(b"".join([packed[k] for k in at.tolist()]), kind).reshape(-1, DIMENSIONS)
    return out


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first: small numbers compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _from_planes(raw: bytes, at: int, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel()


def _blob(token: np.ndarray, n: np.ndarray, sums: np.ndarray) -> bytes:
    """Tokens with their numbers and sums, compressed: sums of rare tokens are small numbers, dimension by dimension."""
    wide = np.abs(sums).max(1, initial=0) > 127
    order = np.argsort(wide, kind="stable")  # those whose sums fit one byte first
    token, n, sums, few = token[order], n[order], sums[order], int((~wide).sum())
    raw = np.array([len(token), few], np.int64).tobytes() + token.tobytes() + _planes(n.astype(np.int64))
    raw += sums[:few].astype(np.int8).T.tobytes() + _planes(sums[few:].astype(np.int64).T.ravel())
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _from_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size, few = np.frombuffer(raw, np.int64, 2).tolist()
    token, at = np.frombuffer(raw, np.uint64, size, 16), 16 + 8 * size
    n, at = _from_planes(raw, at, size, np.int64), at + 8 * size
    sums = np.empty((size, DIMENSIONS), np.int64)
    sums[:few] = np.frombuffer(raw, np.int8, few * DIMENSIONS, at).reshape(DIMENSIONS, few).T
    sums[few:] = _from_planes(raw, at + few * DIMENSIONS, (size - few) * DIMENSIONS, np.int64).reshape(DIMENSIONS, size - few).T
    return token, n, sums


class _Held:
    """Context sums of a task's tokens, added up in place: rows stay where they are, only keys are sorted."""

    def __init__(self) -> None:
        self.token = np.zeros(0, np.uint64)
        self.n = np.zeros(0, np.int64)
        self.sums = np.zeros((0, DIMENSIONS), np.int32)
        self.used = 0
        self.sorted = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def add(self, token: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
        keys, rows = self.sorted
        at = np.minimum(np.searchsorted(keys, token), max(0, len(keys) - 1))
        old = keys[at] == token if len(keys) else np.zeros(len(token), bool)
        self.n[rows[at[old]]] += n[old]
        self.sums[rows[at[old]]] += sums[old]
        new = np.flatnonzero(~old)
        last = self.used + len(new)
        if last > len(self.token):
            room = max(last, min(2 * len(self.token), MOST_HELD + (MOST_HELD >> 1)))
            for name in ("token", "n", "sums"):
                held = getattr(self, name)
                grown = np.zeros((room, *held.shape[1:]), held.dtype)
                grown[: self.used] = held[: self.used]
                setattr(self, name, grown)
        self.token[self.used : last], self.n[self.used : last], self.sums[self.used : last] = token[new], n[new], sums[new]
        self.used = last
        order = np.argsort(self.token[:last])
        self.sorted = self.token[order], order

    def sent(self, buckets: int):
        """Blobs by bucket; the rows are given up."""
        bucket = (self.token[: self.used] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for first, last in zip(heads, [*heads[1:], self.used]):
            some = order[first:last]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[some[0]])]), pa.array([_blob(self.token[some], self.n[some], self.sums[some])], pa.binary())], names=["bucket", "payload"])
        self.used, self.sorted = 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _contexts(batches: Iterator[pa.RecordBatch], buckets: int):
    held = _Held()
    for batch in batches:
        for part in T.slices(batch.column("text")):
            found = T.words(part, _KINDS, lower=True)
            if not len(found.hash):
                continue
            token, own = np.unique(found.hash, return_inverse=True)
            index = np.vstack([index_vectors(token), np.zeros((1, DIMENSIONS), np.int8)])  # the last row: no token
            order = np.argsort(own, kind="stable")
            sums = np.zeros((len(token), DIMENSIONS), np.int32)
            for first in range(0, len(order), _TOKENS):
                here = order[first : first + _TOKENS]
                around = np.zeros((len(here), DIMENSIONS), np.int16)
                for step in (*range(-REACH, 0), *range(1, REACH + 1)):
                    there = np.clip(here + step, 0, len(own) - 1)
                    same = (found.row[there] == found.row[here]) & (there == here + step)
                    around += index[np.where(same, own[there], len(token))]
                heads = np.flatnonzero(np.diff(own[here], prepend=-1))
                sums[own[here[heads]]] += np.add.reduceat(around, heads, dtype=np.int32)
            held.add(token, np.bincount(own, minlength=len(token)), sums)
            if held.used > MOST_HELD:
                yield from held.sent(buckets)
    if held.used:
        yield from held.sent(buckets)


def _by_token(batches: Iterator[pa.RecordBatch]):
    """Blobs sorted by bucket: one row for each token of a bucket."""
    current, waiting = None, []

    def done():
        token, n, sums = (np.concatenate(x) for x in zip(*map(_from_blob, waiting)))
        token, own = np.unique(token, return_inverse=True)
        order = np.argsort(own, kind="stable")
        heads = np.flatnonzero(np.diff(own[order], prepend=-1))
        n, sums = np.add.reduceat(n[order], heads), np.add.reduceat(sums[order], heads)
        for first in range(0, len(token), 1 << 14):
            some = slice(first, first + (1 << 14))
            yield _rows(token[some].view(np.int64), n[some], sums[some])

    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
            if bucket != current and waiting:
                yield from done()
                waiting = []
            current = bucket
            waiting.append(payload.as_py())
    if waiting:
        yield from done()


def _totals(batches: Iterator[pa.RecordBatch]):
    n, sums = 0, np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        n += int(batch.column("n").to_numpy().sum())
        sums += _wide(batch.column("vector").to_pylist()).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tobytes()], pa.binary())], names=["n", "sums"])


def unit(sums: np.ndarray, n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Word vectors of context sums: mean context less the corpus mean, of unit length."""
    vectors = sums / n[:, None] - mean
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm > 1e-9, norm, 1)).astype(np.float32)


def _known(batches: Iterator[pa.RecordBatch], common):
    """Each text's number of tokens, the sum of its common tokens' vectors and its other tokens."""
    tokens, vectors = common.value
    kind = pa.struct([("token", pa.int64()), ("times", pa.int64())])
    for batch in batches:
        for part in T.slices(batch.column("text")):
            found = T.words(part, _KINDS, lower=True)
            sums = np.zeros((len(part), DIMENSIONS))
            at = np.minimum(np.searchsorted(tokens, found.hash), max(0, len(tokens) - 1))
            hit = tokens[at] == found.hash if len(tokens) else np.zeros(len(at), bool)
            places = np.flatnonzero(hit)
            for first in range(0, len(places), _TOKENS):
                here = places[first : first + _TOKENS]
                row = found.row[here]
                head = np.flatnonzero(np.diff(row, prepend=-1))
                sums[row[head]] += np.add.reduceat(vectors[at[here]].astype(np.float64), head)
            row, token = found.row[~hit], found.hash[~hit]
            order = np.lexsort((token, row))
            row, token = row[order], token[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
            head = np.flatnonzero(new)
            pairs = pa.StructArray.from_arrays([pa.array(token[head].view(np.int64)), pa.array(np.diff(np.append(head, len(row))))], fields=list(kind))
            stops = np.concatenate([[0], np.cumsum(np.bincount(row[head], minlength=len(part)))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key").slice(part.first, len(part)), pa.array(found.per_row), pa.array([v.tobytes() for v in sums], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pairs)], names=["text_key", "tokens", "sums", "rare"])


def _added(batches: Iterator[pa.RecordBatch], mean: np.ndarray):
    """Rows of one text after the other: (text_key, mean of its tokens' vectors)."""
    current, tokens, total = None, 0, np.zeros(DIMENSIONS)

    def done(rows):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                                          names=["text_key", "pooled"])
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("text_key").to_pylist()
        count, times = batch.column("tokens").to_numpy(), batch.column("times").to_numpy()
        raw, own, rare = batch.column("vector").to_pylist(), np.zeros((len(keys), DIMENSIONS)), times > 0
        own[~rare] = np.frombuffer(b"".join([r for r, other in zip(raw, rare) if not other])).reshape(-1, DIMENSIONS)
        sums = _wide([r for r, other in zip(raw, rare) if other])
        own[rare] = unit(sums, batch.column("n").to_numpy()[rare], mean) * times[rare, None]
        heads = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]]
        out = []
        for k, some, number in zip(heads, np.add.reduceat(own, heads), np.add.reduceat(count, heads)):
            if keys[k] != current:
                if current is not None:
                    out.append((current, total / max(1, tokens)))
                current, tokens, total = keys[k], 0, np.zeros(DIMENSIONS)
            tokens, total = tokens + int(number), total + some
        if out:
            yield done(out)
    if current is not None:
        yield done([(current, total / max(1, tokens))])


def text_key() -> Column:
    """128 bits of a digest of the text; null is empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)), 1, 16)


def known_texts(docs: DataFrame, common) -> DataFrame:
    """``_known`` of every distinct text, written once.

    Most texts have no copy: only the keys meet, and of copied texts the rows. Where too many are
    copied for their keys to go to every task, the rows of all texts meet.
    """
    def found(some: DataFrame) -> DataFrame:
        return some.mapInArrow(lambda b: _known(b, common), "text_key binary, tokens long, sums binary, rare array<struct<token: long, times: long>>")

    def once(rows: DataFrame) -> DataFrame:
        return rows.groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("tokens", "sums", "rare")])

    texts = docs.select(text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    copied = cut(texts.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select("text_key"))
    number = copied.limit(MOST_COPIED + 1).count()
    if number > MOST_COPIED:
        known = once(found(texts))
    elif number:
        keys = F.broadcast(copied)
        known = found(texts.join(keys, "text_key", "left_anti")).unionByName(once(found(texts.join(keys, "text_key", "left_semi"))))
    else:
        known = found(texts)
    known = cut(known)
    discard(copied)
    return known


def pooled_texts(docs: DataFrame) -> DataFrame:
    """(text_key, pooled) of every distinct text, from a vector for each token of the corpus."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    buckets = (texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // BUCKET_BYTES + 1
    tasks = min(2 * buckets, 20 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = cut(
        texts.mapInArrow(lambda b: _contexts(b, buckets), "bucket long, payload binary")
        .repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_token, _SUMS_SQL))
    totals = sums.mapInArrow(_totals, "n long, sums binary").collect()  # a row from each task
    mean = sum((np.frombuffer(r.sums, np.int64) for r in totals), np.zeros(DIMENSIONS)) / max(1, sum(r.n for r in totals))
    # tokens that occur more often than the first frequency which no longer fits
    least = 0
    often = 0
    for r in sums.groupBy("n").count().orderBy(F.desc("n")).limit(COMMON).collect():  # a row for each frequency
        often += r["count"]
        if often > COMMON:
            least = r["n"]
            break
    rows = sums.where(F.col("n") > least).toArrow()  # at most COMMON rows
    token = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    vectors = unit(_wide(rows.column("vector").to_pylist()), rows.column("n").to_numpy(), mean)
    common = docs.sparkSession.sparkContext.broadcast((token[order], vectors[order]))
    known = known_texts(docs, common)
    parts = known.selectExpr("text_key", "tokens", "0L AS times", "0L AS n", "sums AS vector")
    if least:
        others = known.selectExpr("text_key", "inline(rare)").join(sums.where(F.col("n") <= least), "token")
        parts = parts.unionByName(others.selectExpr("text_key", "0L AS tokens", "times", "n", "vector"))
        parts = parts.repartition("text_key").sortWithinPartitions("text_key")
    pooled = cut(parts.mapInArrow(lambda b: _added(b, mean), "text_key binary, pooled binary"))
    discard(known, sums)
    return pooled


class Network:
    """One hidden layer, fitted with Adam on the whole sample, then a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, steps: int = 400):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.layers = None
        if len(y) < 10 or y.min() == y.max():
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        draw = np.random.default_rng(11)
        w = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        fit = ~held if 0 < len(np.unique(y[~held])) == 2 else np.ones(len(y), bool)
        z, target = (x[fit] - self.mean) / self.scale, y[fit]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for step in range(1, steps + 1):
            hidden = np.tanh(z @ w[0] + w[1])
            error = (1 / (1 + np.exp(-(hidden @ w[2] + w[3]))) - target) / len(target)
            back = error[:, None] * w[2] * (1 - hidden**2)
            slopes = [z.T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ error + 1e-4 * w[2], np.array([error.sum()])]
            for k, slope in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * slope
                v[k] = 0.999 * v[k] + 0.001 * slope**2
                w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.layers, self.temperature = w, 1.0
        if held.any():
            logits, kept = self._logits(x[held]), y[held]
            loss = lambda t: float(np.mean(np.logaddexp(0, logits / t) - kept * logits / t))
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.layers[0] + self.layers[1])
        return hidden @ self.layers[2] + self.layers[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -30, 30)))


def may_learn(doc_id: Column) -> Column:
    """Labels that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Network]:
    """(text_key, pooled) of the texts, and the fitted network."""
    pooled = pooled_texts(docs)
    sample = cut(
        labels.where(may_learn(F.col("doc_id")) & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    # of several texts of one id the smallest key; at most MOST_LABELLED ids
    chosen = cut(known.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text_key").alias("text_key")))
    rows = sorted(pooled.join(checked_broadcast(chosen, 64), "text_key").select("doc_id", "label", "pooled").collect())
    x = np.array([np.frombuffer(r.pooled) for r in rows]).reshape(-1, DIMENSIONS)
    y = np.array([r.label for r in rows])
    held = np.array([k % 5 == 0 for k in range(len(rows))], bool)
    return pooled, Network(x, y, held)


def _scores(batches: Iterator[pa.RecordBatch], network: Network):
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column("pooled").to_pylist())).reshape(-1, DIMENSIONS)
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(network.score(x))], names=["_text_key", "score"])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a column ``score``; a column of that name is replaced."""
    pooled, network = fit(docs, labels)
    scores = cut(pooled.mapInArrow(lambda b: _scores(b, network), "_text_key binary, score double"))
    rows = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    return rows.join(checked_broadcast(scores, 64), text_key() == F.col("_text_key")).select(*rows.columns, "score")
