"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

The test items are the indexed collection, every training passage is a query. A passage is
a window of ``2 * stride`` words that begins every ``stride`` words, and ``stride`` is at
least the longest item's number of words, so an item that stands in a text stands whole in
one passage. An item's BM25 score is divided by the score of the item with itself, so one
threshold serves all items: 1 is reached by a passage with all of an item's terms.

Block-max WAND runs for a block of passages at a time. A passage is dropped when the
largest contributions of its terms don't add up to the threshold; then, per block of items,
when the block's largest contributions don't; only items of the blocks that are left are
scored. Both bounds are never below the score, so all items above the threshold are found.
Each found item is verified: enough of its question's and of its answer's word trigrams
must stand in the passage.

The index is built from bounded shards of items: one pass over the texts for each shard,
with document frequencies and lengths over all items. Null and empty texts or items match
nothing, repeated rows of an item id count once (the smallest text), of a document together.
Only matches are returned, so an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsift.llm import textbytes as T
from logsift.llm.shared import cut

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION_OVERLAP = ANSWER_OVERLAP = 0.5
ITEMS_PER_BLOCK = 8
LEAST_STRIDE = 64
#: Bytes of item texts in an index shard; its index takes some tens of them per byte.
SHARD_BYTES = 4 << 20
GRAM = 3
_CELLS = 4 << 20

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; of a lone sentence its last quarter of words."""
    sentences = [s for s in _SENTENCE.split(text.strip()) if s]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    word = text.split()
    cut_at = max(1, len(word) * 3 // 4) if len(word) > 1 else len(word)
    return " ".join(word[:cut_at]), " ".join(word[cut_at:])


def _found(texts: list[str]) -> T.Words:
    (part,) = T.slices(pa.array(texts, pa.large_string()), 1 << 40, 1 << 40)
    return T.words(part, T.LETTERS, lower=True)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (of shorter texts: words) of each text: hashes and bounds."""
    found = _found(texts)
    value, first = T.grams(found, GRAM)
    row = found.row[first]
    short = found.per_row[found.row] < GRAM
    value, row = np.concatenate([value, found.hash[short]]), np.concatenate([row, found.row[short]])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (np.diff(row) > 0) | (value[1:] != value[:-1])
    return value[keep], np.searchsorted(row[keep], np.arange(len(texts) + 1))


class Index:
    """Impact-ordered postings of a shard of items, as arrays."""

    def __init__(self, ids: list[int], texts: list[str], frequency: dict[int, int], items: int, mean_words: float):
        found = _found(texts)
        pairs, count = np.unique(np.stack([found.row.astype(np.uint64), found.hash], 1), axis=0, return_counts=True)
        item, term = pairs[:, 0].astype(np.int64), pairs[:, 1]
        df = np.array([frequency[int(t)] for t in term.view(np.int64).tolist()], float)
        length = found.per_row[item]
        impact = np.log1p((items - df + 0.5) / (df + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean_words))
        impact /= np.bincount(item, impact, len(ids))[item]
        order = np.lexsort((item, term))
        item, term, impact = item[order], term[order], impact[order]
        self.ids = np.array(ids, np.int64)
        self.terms, start = np.unique(term, return_index=True)
        self.most = np.maximum.reduceat(impact, start)
        # (term, block) entries and the postings of each
        block = item // ITEMS_PER_BLOCK
        of_term = np.searchsorted(self.terms, term)
        new = np.ones(len(term), bool)
        new[1:] = (np.diff(of_term) > 0) | (np.diff(block) > 0)
        entry = np.flatnonzero(new)
        self.entry_block, self.entry_most = block[entry], np.maximum.reduceat(impact, entry)
        self.entry_start, self.entry_size = entry, np.diff(np.append(entry, len(term)))
        self.term_start = np.searchsorted(of_term[entry], np.arange(len(self.terms)))
        self.term_size = np.bincount(of_term[entry], minlength=len(self.terms))
        self.item, self.impact = item, impact
        self.blocks = -(-len(ids) // ITEMS_PER_BLOCK)
        question, answer = zip(*map(question_and_answer, texts))
        self.question, self.answer = _grams(list(question)), _grams(list(answer))

    def above(self, passage: np.ndarray, term: np.ndarray, threshold: float):
        """Items at or above the threshold: passages, items, scores. Input: distinct pairs."""
        passage, term = self._alive(passage, term, threshold)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, _CELLS // self.blocks)
        for first in range(0, int(passage.max()) + 1 if len(passage) else 0, step):
            a, b = np.searchsorted(passage, [first, first + step])
            some, terms = passage[a:b] - first, term[a:b]
            size = self.term_size[terms]
            entry = T.concatenated_ranges(self.term_start[terms], size)
            cell = np.repeat(some, size) * self.blocks + self.entry_block[entry]
            bound = np.bincount(cell, self.entry_most[entry], step * self.blocks)
            left = bound[cell] >= threshold - 1e-9
            entry, cell = entry[left], cell[left]
            size = self.entry_size[entry]
            posting = T.concatenated_ranges(self.entry_start[entry], size)
            pair, inverse = np.unique(np.repeat(cell // self.blocks, size) * len(self.ids) + self.item[posting], return_inverse=True)
            score = np.bincount(inverse, self.impact[posting], len(pair))
            good = score >= threshold
            out.append((pair[good] // len(self.ids) + first, pair[good] % len(self.ids), score[good]))
        return [np.concatenate(x) for x in zip(*out)]

    def _alive(self, passage, term, threshold):
        bound = np.bincount(passage, self.most[term]) if len(passage) else np.zeros(0)
        keep = bound[passage] >= threshold - 1e-9
        return passage[keep], term[keep]


def _overlap(grams: tuple[np.ndarray, np.ndarray], item: int, passage: np.ndarray) -> float:
    own = grams[0][grams[1][item] : grams[1][item + 1]]
    return float(np.isin(own, passage).mean()) if len(own) else 1.0


def _match(batches: Iterator[pa.RecordBatch], shared, stride: int, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                        ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    index: Index = shared.value

    def work(batch):
        for part in T.slices(batch.column("text")):
            found = T.words(part, T.LETTERS, lower=True)
            if not len(found.hash) or not len(index.terms):
                continue
            term = np.minimum(np.searchsorted(index.terms, found.hash), len(index.terms) - 1)
            hit = np.flatnonzero(index.terms[term] == found.hash)
            windows = np.maximum(1, -(-found.per_row // stride) - 1)
            base = np.cumsum(windows) - windows
            row, term = found.row[hit], term[hit]
            cell = (hit - found.first_of_row[row]) // stride
            here, before = cell < windows[row], cell > 0
            key = np.unique(np.concatenate([(base[row] + cell)[here] * len(index.terms) + term[here],
                                            (base[row] + cell - 1)[before] * len(index.terms) + term[before]]))
            passage, item, score = index.above(key // len(index.terms), key % len(index.terms), threshold)
            rows = []
            for p, i, s in zip(passage.tolist(), item.tolist(), score.tolist()):
                r = int(np.searchsorted(base, p, "right")) - 1
                first = int(found.first_of_row[r]) + (p - int(base[r])) * stride
                last = min(first + 2 * stride, int(found.first_of_row[r] + found.per_row[r]))
                some = T.Words(*[None] * 2, np.zeros(last - first, np.int64), found.hash[first:last], *[None] * 2)
                grams = np.concatenate([T.grams(some, GRAM)[0], some.hash])
                q, a = _overlap(index.question, i, grams), _overlap(index.answer, i, grams)
                if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP:
                    rows.append((part.first + r, int(index.ids[i]), s, q, a))
            if rows:
                at, *rest = zip(*rows)
                yield pa.table([batch.column("doc_id").take(pa.array(at)), *map(pa.array, rest)], schema=schema)
    return T.mapped(batches, work, schema)


def _terms(batches: Iterator[pa.RecordBatch]):
    """Distinct words of each item, and its number of words once."""
    for batch in batches:
        for part in T.slices(batch.column("text")):
            found = T.words(part, T.LETTERS, lower=True)
            pairs = np.unique(np.stack([found.row.astype(np.uint64), found.hash], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].view(np.int64))], names=["term"])


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, n_passages of all matches."""
    spark = docs.sparkSession
    items = cut(
        items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        .where(F.col("item_id").isNotNull() & F.col("text").rlike("[0-9A-Za-z]|[^\\x00-\\x7F]"))
        .groupBy("item_id").agg(F.min("text").alias("text")))
    words = F.size(F.filter(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), lambda w: w != ""))
    n, mean, longest, size = items.agg(F.count("*"), F.avg(words), F.max(words), F.sum(F.octet_length("text"))).first()
    result = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    if not n:
        return spark.createDataFrame([], result + ", n_passages long")
    frequency = cut(items.mapInArrow(_terms, "term long").groupBy("term").agg(F.count("*").alias("df")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards, found = -(-size // SHARD_BYTES), None
    for k in range(shards):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        rows = sorted((r.item_id, r.text) for r in some.collect())  # about SHARD_BYTES
        if not rows:
            continue
        own = frequency.join(some.mapInArrow(_terms, "term long").distinct(), "term", "left_semi")
        index = Index([i for i, _ in rows], [t for _, t in rows], {r.term: r.df for r in own.collect()}, n, mean)
        shared, stride = spark.sparkContext.broadcast(index), max(LEAST_STRIDE, longest)
        matched = texts.mapInArrow(lambda b, s=shared, w=stride: _match(b, s, w, threshold), result)
        found = matched if found is None else found.unionByName(matched)
    return found.groupBy("doc_id", "item_id").agg(
        *[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")], F.count("*").alias("n_passages"))
