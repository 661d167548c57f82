"""Substring dedup over word windows, by super-k-mers.

A window is ``window`` consecutive words of one text; words are ``[^\\x20\\x09-\\x0D]+``,
unchanged. Consecutive windows that share a minimiser travel as one packed string (words
joined by one space) to the minimiser's bucket; there the windows of the distinct strings
are sorted, and each window's first document, the smallest id, is read off the sorted run.
Every later document loses the words that the window covers. Windows are judged on the
input, not on what is left. Windows compare by 128 bits of hash over their words.

A copy of a whole text (same bytes) needs no bucket: each of its windows also starts in
the smallest copy. Null or empty text: no words. Fewer than ``window`` words: nothing is
removed. Equal rows of one id count once; different texts of one id are documents of their
own, each with a row, the one with the smaller digest being the smaller document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsift.llm import textbytes as T
from logsift.llm.routing import Bucket, Runs, distinct_texts, route
from logsift.llm.shared import checked_broadcast, cut, distinct_documents, with_own_ids

GRAM = 3
#: Packed bytes per byte of text: runs of about six windows carry thirteen words more.
SPREAD = 3.2


def _runs(window: int):
    width = window - GRAM + 1

    def make(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[int, Runs]]:
        ids = ids.to_numpy()
        for part in T.slices(texts):
            found = T.words(part, T.NOT_SPACE, lower=False)
            n = len(found.hash)
            if n < window:
                continue
            value = found.hash[: n - GRAM + 1].copy()
            for j in range(1, GRAM):
                value = T.mix(value * np.uint64(0x9E3779B97F4A7C15) + found.hash[j : n - GRAM + 1 + j])
            least = T.sliding_minimum(value, width)
            inside = found.row[: n - window + 1] == found.row[window - 1 :]
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]])
            first = at[new]
            count = np.diff(np.append(np.flatnonzero(new), len(at)))
            last = first + count - 1 + window - 1
            # words joined by one space: each word's bytes and the byte after it
            length = found.end - found.start + 1
            source = T.concatenated_ranges(found.start, length)
            joined = np.append(part.data, np.uint8(32))[source]
            stop = np.cumsum(length)
            joined[stop - 1] = 32
            begin = stop - length
            raw = joined.tobytes()
            packed = [raw[a:b] for a, b in zip(begin[first].tolist(), (stop[last] - 1).tolist())]
            row = found.row[first]
            yield int(part.bounds[-1]), Runs(T.mix(value[least[first]]), packed, ids[part.first + row], first - found.first_of_row[row])
    return make


def _judge(window: int):
    def judge(bucket: Bucket):
        """Runs of words whose window starts in a smaller document too."""
        # the smallest document of every distinct string, then of every window
        smallest = np.full(len(bucket.packed), np.iinfo(np.int64).max)
        np.minimum.at(smallest, bucket.entry, bucket.doc_id)
        data = np.frombuffer(b"\n".join(bucket.packed), np.uint8)
        sizes = np.array([len(p) for p in bucket.packed])
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        part = T.Slice(0, len(sizes), data, np.minimum(bounds, len(data)))
        found = T.words(part, T.NOT_SPACE, lower=False)
        value, at = T.grams(found, window)
        other = found.hash.copy()
        found.hash = T.mix(other ^ np.uint64(0xA5A5A5A5DEADBEEF))
        value2, _ = T.grams(found, window)
        string = found.row[at]
        order = np.lexsort((value2, value))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (value[a] != value[b]) | (value2[a] != value2[b])
        lowest = np.minimum.reduceat(smallest[string[order]], np.flatnonzero(new))
        first_doc = np.empty(len(order), np.int64)
        first_doc[order] = lowest[np.cumsum(new) - 1]
        # windows lie string by string; occurrences take over their string's windows
        per_string = np.bincount(string, minlength=len(sizes))
        begin = np.cumsum(per_string) - per_string
        # a string whose windows all start first in its own smallest document only concerns other occurrences
        firsts = np.minimum.reduceat(first_doc, begin)
        concerned = firsts[bucket.entry] < bucket.doc_id
        entry, doc, start = bucket.entry[concerned], bucket.doc_id[concerned], bucket.start[concerned]
        number = per_string[entry]
        position = T.concatenated_ranges(begin[entry], number)
        owner = np.repeat(np.arange(len(entry)), number)
        hit = first_doc[position] < doc[owner]
        offset = position - begin[entry][owner]
        owner, offset = owner[hit], offset[hit]
        if not len(owner):
            return owner, owner, owner
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (np.diff(owner) > 0) | (np.diff(offset) > 1)
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(owner)) - 1
        return doc[owner[head]], start[owner[head]] + offset[head], offset[tail] - offset[head] + window
    return judge


def _apply(batches: Iterator[pa.RecordBatch], window: int, passed: list[str], with_text: bool):
    names = [*passed, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def kept_of(word: list[bytes], spans, is_copy: bool) -> list[bytes]:
        if is_copy:
            return [] if len(word) >= window else word
        kept, at = [], 0
        for span in spans or []:
            if span["start"] > at:
                kept += word[at : span["start"]]
            at = max(at, span["start"] + span["length"])
        return kept + word[at:]

    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, spans, is_copy in zip(*(batch.column(c).to_pylist() for c in ("text", "_spans", "_copy"))):
            # bytes.split() takes exactly the spaces \x20 and \x09-\x0D
            word = (text or "").encode().split()
            kept = kept_of(word, spans, is_copy)
            joined = b" ".join(kept)
            out[0].append(len(word))
            out[1].append(len(word) - len(kept))
            out[2].append(hashlib.sha256(joined).hexdigest())
            if with_text:
                out[3].append(joined.decode())
        made = [pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.int64(), pa.string(), pa.string()])]
        yield pa.RecordBatch.from_arrays([*map(batch.column, passed), *made[: len(names) - len(passed)]], names=names)


def substring_dedup(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """n_words, n_removed, kept_sha256 (and kept_text) of every document with an id.

    The columns of ``docs`` come first (without ``with_text`` only doc_id); the names of the
    results and names that begin with an underscore are taken, columns of ``docs`` that
    have them are dropped.
    """
    own = {"n_words", "n_removed", "kept_sha256", "kept_text"}
    docs = docs.select(*[c for c in docs.columns if c not in own and not c.startswith("_")])
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    passed = docs.columns if with_text else ["doc_id"]
    docs, ids = distinct_documents(docs.select(*dict.fromkeys([*passed, "text"])))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    copies, rest, total = distinct_texts(texts)
    spans = cut(route(rest, total, SPREAD, _runs(window), _judge(window)))
    size = spans.agg(F.max(F.size("spans"))).first()[0] or 0
    later = copies.where("doc_id <> first_id").select("doc_id", F.lit(True).alias("_copy"))
    marked = docs.join(checked_broadcast(later, 48), "doc_id", "left").join(
        checked_broadcast(spans.withColumnRenamed("spans", "_spans"), 64 + 24 * size), "doc_id", "left")
    out = [n for n in docs.columns if n in passed]
    schema = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes if n in out)
    schema += ", n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    found = marked.select(*docs.columns, "_spans", "_copy").mapInArrow(
        lambda b: _apply(b, window, out, with_text), schema)
    return with_own_ids(found, ids, "doc_id")
