"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi pass.

The automaton holds all normal pieces. It runs once over the text; at each position it
follows its output links through every piece that ends there, and each one relaxes the
best score of that position from the position where the piece begins. All words of a block
take each step together, as arrays. A sign that no piece covers is written as its UTF-8
bytes (byte pieces), at a score below any piece's. Ties go to the longer last piece.

Scores are the model's. A model whose scores only count its merges (whole numbers; kind
BPE) has no probabilities, so rank r gets the one that a Zipf law gives it, and scores its
logarithm; ids are then those of the likeliest segmentation, not of the merge order.

As in the model, a space is written as the sign U+2581 and the text gets one space in
front. A U+2581 of the text itself is written as bytes, so decoding restores every text
exactly. No piece has a space sign behind another sign, or a line break beside another
sign (checked when the model is loaded), so the best segmentation of a text is that of its
words one by one, and words that were seen before are not segmented again.

The model's file is read once, on the driver, and sent to the tasks. A null text stays
null (null ids, zero pieces), an empty one has no ids. Repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

MODEL = os.environ.get("LLM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
_UNIT = re.compile(f" +[^ \n{SPACE}]*|\n|{SPACE}|[^ \n{SPACE}]+")
#: Segmented words of each of the two generations that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 100_000, 64
#: Positions of words that are segmented together.
CELLS = 1 << 20


class Pieces:
    """A model's pieces, built from the bytes of its file."""

    def __init__(self, model: bytes):
        loaded = sentencepiece.SentencePieceProcessor(model_proto=model)
        normal, self.byte_id, self.raw = [], {}, []
        for i in range(loaded.get_piece_size()):
            piece = loaded.id_to_piece(i)
            if loaded.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i):
                self.raw.append(b"")
            else:
                normal.append((i, piece, loaded.get_score(i)))
                self.raw.append(piece.replace(SPACE, " ").encode())
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces, so not every text could be restored")
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for _, p, _ in normal):
            raise ValueError("the model has pieces across words")
        scores = np.array([score for *_, score in normal])
        if (scores == np.round(scores)).all():
            rank = np.empty(len(scores))
            rank[np.argsort(-scores, kind="stable")] = np.arange(1, len(scores) + 1)
            scores = -np.log(rank * (1 / rank).sum())
        self.fallback = float(scores.min()) - 10
        self.text = {i: piece for i, piece, _ in normal}
        self._automaton([(i, piece) for i, piece, _ in normal], scores)
        self.remembered: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _automaton(self, normal: list[tuple[int, str]], scores: np.ndarray) -> None:
        """Trie, failure links and output links; children are one sorted array of (node, sign)."""
        children: list[dict[int, int]] = [{}]
        depth, piece, score = [0], [-1], [0.0]
        for (i, text), value in zip(normal, scores.tolist()):
            node = 0
            for sign in map(ord, text):
                if sign not in children[node]:
                    children[node][sign] = len(children)
                    children.append({})
                    depth.append(depth[node] + 1)
                    piece.append(-1)
                    score.append(0.0)
                node = children[node][sign]
            piece[node], score[node] = i, value
        failure, output = [0] * len(children), [0] * len(children)
        queue = list(children[0].values())
        for node in queue:  # by depth; the list grows while it is read
            for sign, child in children[node].items():
                back = failure[node]
                while back and sign not in children[back]:
                    back = failure[back]
                failure[child] = children[back].get(sign, 0)
                queue.append(child)
            # the nearest shorter piece that ends here too
            output[node] = failure[node] if piece[failure[node]] >= 0 else output[failure[node]]
        keys = sorted((node << 21 | sign, child) for node, own in enumerate(children) for sign, child in own.items())
        self.keys, self.targets = (np.array(c, np.int64) for c in zip(*keys))
        self.failure, self.output, self.depth, self.piece = (np.array(c, np.int64) for c in (failure, output, depth, piece))
        self.score = np.array(score)

    def _step(self, state: np.ndarray, sign: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            key = state[open_] << 21 | sign[open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            out[open_[there]] = self.targets[at[there]]
            open_ = open_[~there & (state[open_] > 0)]
            state[open_] = self.failure[state[open_]]
        return out

    def segment(self, units: list[str]) -> list[bytes]:
        """Packed ids of the best segmentation of each of some words, longest words first."""
        signs = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(u) for u in units])
        first = np.cumsum(sizes) - sizes
        longest = int(sizes[0])
        best = np.zeros((len(units), longest + 1))
        piece, size = np.full(best.shape, -1, np.int32), np.ones(best.shape, np.int32)
        state = np.zeros(len(units), np.int64)
        still = len(units)
        for end in range(1, longest + 1):
            while sizes[still - 1] < end:
                still -= 1
            state[:still] = self._step(state[:still], signs[first[:still] + end - 1])
            best[:still, end] = best[:still, end - 1] + self.fallback
            who = np.arange(still)
            node = np.where(self.piece[state[:still]] >= 0, state[:still], self.output[state[:still]])
            while True:  # output links, the longest piece first
                who, node = who[node > 0], node[node > 0]
                if not len(who):
                    break
                found = best[who, end - self.depth[node]] + self.score[node]
                better = found > best[who, end]
                some, by = who[better], node[better]
                best[some, end], piece[some, end], size[some, end] = found[better], self.piece[by], self.depth[by]
                node = self.output[node]
        # back from each word's end, one piece at a time for all words
        rows, at, steps = np.arange(len(units)), sizes.copy(), []
        while at.any():
            steps.append(np.where(at > 0, piece[rows, at], -2))
            at -= np.where(at > 0, size[rows, at], 0)
        ids = np.stack(steps[::-1], 1).astype(np.int32)
        valid = ids > -2
        packed = ids[valid].tobytes()
        stop = 4 * np.cumsum(valid.sum(1))
        out = [packed[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]
        for k in np.flatnonzero((ids == -1).any(1)).tolist():  # signs that no piece covers
            spelled, sign = [], 0
            for i in ids[k][valid[k]].tolist():
                spelled += [i] if i >= 0 else [self.byte_id[b] for b in units[k][sign].encode()]
                sign += len(self.text[i]) if i >= 0 else 1
            out[k] = np.array(spelled, np.int32).tobytes()
        return out

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Segments words that aren't remembered; long ones are returned, not kept.

        When a generation is full, it becomes the older one, and a word that is met again moves on
        from there: what is forgotten wasn't seen for a whole generation.
        """
        if len(self.remembered) + len(units) > REMEMBERED:
            self.older, self.remembered = self.remembered, {}
        fresh = []
        for unit in units.difference(self.remembered):
            ids = self.older.get(unit)
            if ids is None:
                fresh.append(unit)
            else:
                self.remembered[unit] = ids
        fresh.sort(key=len, reverse=True)
        known, first = {}, 0
        while first < len(fresh):
            last = first + max(1, CELLS // (len(fresh[first]) + 1))
            some = fresh[first:last]
            for unit, ids in zip(some, self.segment([u.replace(" ", SPACE) for u in some])):
                if unit == SPACE:
                    ids = np.array([self.byte_id[b] for b in SPACE.encode()], np.int32).tobytes()
                (self.remembered if len(unit) <= LONGEST else known)[unit] = ids
            first = last
        return known

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text as packed 32-bit numbers."""
        units = [_UNIT.findall(" " + t) if t else [] for t in texts]
        known = self._learn(set().union(*units))
        if known:
            known.update(self.remembered)
        get = (known or self.remembered).__getitem__
        return [None if t is None else b"".join(map(get, u)) for t, u in zip(texts, units)]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.raw[i] for i in ids])[1:].decode()


_loaded: dict[str, Pieces] = {}


def _pieces(shared) -> Pieces:
    """One automaton for each worker process and model."""
    model = shared.value
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def _shared_model(spark: SparkSession, model: str):
    with open(model, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _encode(batches: Iterator[pa.RecordBatch], shared):
    pieces = _pieces(shared)
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            some = batch.slice(first, 500)
            packed = pieces.encode(some.column("text").to_pylist())
            sizes = [len(p or b"") // 4 for p in packed]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(p or b"" for p in packed), np.int32)),
                                           mask=pa.array([p is None for p in packed]))
            yield pa.RecordBatch.from_arrays([*some.columns, ids], names=[*some.schema.names, "ids"])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of ``docs`` with their ids; a column ``ids`` is replaced."""
    rows = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    shared = _shared_model(docs.sparkSession, model)
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + ", ids array<int>"
    return rows.mapInArrow(lambda b: _encode(b, shared), schema)


def _decode(batches: Iterator[pa.RecordBatch], shared):
    pieces = _pieces(shared)
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            some = batch.slice(first, 500)
            texts = [None if not i.is_valid else pieces.decode(i.values.to_pylist()) for i in some.column("ids")]
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*some.schema.names, "decoded"])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows with the texts that their ``ids`` stand for in a column ``decoded``."""
    rows = encoded.drop("decoded")
    shared = _shared_model(encoded.sparkSession, model)
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + ", decoded string"
    return rows.mapInArrow(lambda b: _decode(b, shared), schema)


def _both(batches: Iterator[pa.RecordBatch], shared, keep: bool):
    yield from _decode(_encode(batches, shared), shared)
    if not keep:
        pieces = _pieces(shared)
        pieces.remembered, pieces.older = {}, {}


def encode_and_decode(docs: DataFrame, model: str = MODEL, keep: bool = True) -> DataFrame:
    """``decode(encode(docs))`` with one worker process and one automaton for a task.

    ``keep``: whether words are remembered from task to task; other work of the same workers has their memory otherwise.
    """
    rows = docs.drop("ids", "decoded").withColumn("text", F.col("text").cast("string"))
    shared = _shared_model(docs.sparkSession, model)
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + ", ids array<int>, decoded string"
    return rows.mapInArrow(lambda b: _both(b, shared, keep), schema)


def digests(decoded: DataFrame) -> DataFrame:
    """Counts, a digest of the ids in order, and whether decoding restored the text."""
    return decoded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("restored"))
