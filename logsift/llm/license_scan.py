"""License scan: ordered signature rules behind a keyword prefilter.

Words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text with A-Z in
lower case. Word hashes tell, for a block of texts at once, which texts hold one of a rule's
keywords; only there the rule's pattern runs, over the words joined by one space. A
detection is an interval of words. Detections are taken by priority, then length, then
place; one that lies inside an interval that was taken before is suppressed. The base
phrases always stay and suppress nothing.

``score`` is the chance that at least one detection is right, taking the rules'
confidences as independent. A null text is an empty one: no words, labels empty, places
null, score 0. Repeated rows and null ids are kept as they come.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsift.llm import textbytes as T
from logsift.llm.license_rules import rules

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                     ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                     ("spans", pa.string())])
COLUMNS = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
           "labels string, score double, spans string")


@functools.cache
def _compiled():
    """Rules with bounded patterns, and the hashes of their keywords."""
    out = [(label, priority, confidence, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"))
           for label, priority, confidence, _, pattern in rules()]
    keywords = [set(words.split()) for *_, words, _ in rules()]
    distinct = sorted(set().union(*keywords))
    raw = np.frombuffer("".join(distinct).encode(), np.uint8)
    stop = np.cumsum([len(k) for k in distinct])
    value = T.hash_spans(raw, np.concatenate([[0], stop[:-1]]), stop)
    order = np.argsort(value)
    by_keyword: list[list[int]] = [[k for k, w in enumerate(keywords) if distinct[i] in w] for i in order.tolist()]
    return out, value[order], by_keyword


def detections(text: str, tried: list[int]) -> tuple[list, list]:
    """(start, end, label, confidence) of base places and of the other rules' kept ones."""
    compiled, _, _ = _compiled()
    base, found = [], []
    for k in tried:
        label, priority, confidence, pattern = compiled[k]
        for m in pattern.finditer(text):
            if m.end() > m.start():
                (found if priority else base).append((priority, m.start() - m.end(), m.start(), m.end(), label, confidence))
    taken: list = []
    # taken intervals that no other holds: starts and ends both ascend, so one place decides
    starts, ends = [], []
    for _, _, start, end, label, confidence in sorted(found):
        at = bisect.bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        taken.append((start, end, label, confidence))
        first = last = bisect.bisect_left(starts, start)
        while last < len(ends) and ends[last] <= end:
            last += 1
        starts[first:last], ends[first:last] = [start], [end]
    return [(s, e, label, c) for _, _, s, e, label, c in sorted(base, key=lambda d: d[2])], sorted(taken)


def _scan(batches: Iterator[pa.RecordBatch]):
    _, keyword_hash, by_keyword = _compiled()

    def work(batch):
        for part in T.slices(batch.column("text")):
            found = T.words(part, T.LETTERS, lower=True)
            at = np.minimum(np.searchsorted(keyword_hash, found.hash), len(keyword_hash) - 1)
            hit = np.flatnonzero(keyword_hash[at] == found.hash)
            tried: dict[int, set[int]] = {}
            for row, keyword in set(zip(found.row[hit].tolist(), at[hit].tolist())):
                tried.setdefault(row, set()).update(by_keyword[keyword])
            n = len(part)
            n_base, score = np.zeros(n, np.int64), np.zeros(n)
            first, last, base_labels, labels, spans = [None] * n, [None] * n, [""] * n, [""] * n, [""] * n
            lower = T.LOWER[part.data].tobytes() if tried else b""
            for row, some in tried.items():
                a = int(found.first_of_row[row])
                b = a + int(found.per_row[row])
                text = b" ".join([lower[s:e] for s, e in zip(found.start[a:b].tolist(), found.end[a:b].tolist())]).decode()
                base, kept = detections(text, sorted(some))
                if not base and not kept:
                    continue
                begins = np.flatnonzero(np.frombuffer((" " + text).encode("utf-32-le"), np.uint32) == 32)
                word = lambda c: int(np.searchsorted(begins, c))
                n_base[row] = len(base)
                if base:
                    first[row], last[row] = word(base[0][0]), word(base[-1][0])
                base_labels[row] = ",".join(sorted({d[2] for d in base}))
                labels[row] = ",".join(sorted({d[2] for d in base + kept}))
                strongest: dict[str, float] = {}
                for *_, label, confidence in base + kept:
                    strongest[label] = max(confidence, strongest.get(label, 0.0))
                score[row] = 1 - float(np.prod([1 - c for _, c in sorted(strongest.items())]))
                spans[row] = ";".join(f"{d[2]}:{word(d[0])}-{word(d[1]) - 1}" for d in sorted(base + kept))
            yield pa.table([
                batch.column("doc_id").slice(part.first, n), pa.array(found.per_row), pa.array(n_base), pa.array(first, pa.int64()),
                pa.array(last, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score), pa.array(spans)], schema=_SCHEMA)
    return T.mapped(batches, work, _SCHEMA)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``; ``spans`` lists label:first-last word of the detections."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, COLUMNS)
