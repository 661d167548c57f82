"""Suffix-array dedup of byte strings of a fixed length, by Lyndon suffix groups.

Every byte that lies in a ``length``-byte string which also starts anywhere else, in the
same document or another, is removed. Strings are judged on the input, overlaps count.

Consecutive windows that share a minimiser travel as one string to a bucket, where a string
is kept once however often it occurs. Strings of one minimiser can share windows; they are
laid end to end (each closed by a symbol of its own), cut into tokens of a few words at
places that three neighbouring bytes decide, and the suffixes of the token sequence are put
in order by ``suffix_groups``. A window that starts inside a token is ordered by the bytes
up to the next cut and the suffix there. In this order equal windows are neighbours, so one
comparison with the next window finds the repeated ones.
Windows compare by a 64-bit hash of their bytes within an order that already groups them.

Texts with whole copies are known from digests and only serve as a source for the others.
Null or empty texts, and texts shorter than ``length``, lose nothing. Equal rows of one id
count once; different texts of one id are documents of their own, each with a row. Rows
without id have no row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsift.llm import textbytes as T
from logsift.llm.routing import Bucket, Runs, distinct_texts, route
from logsift.llm.shared import checked_broadcast, cut, distinct_documents, with_own_ids
from logsift.llm.suffix_groups import suffix_order

GRAM = 32
SPREAD = 3.2
#: Bytes of the strings whose suffixes are ordered together; strings that can share windows
#: are never divided.
ORDER_BYTES = 1 << 20

#: Bytes of text whose windows are looked at together.
_PIECE = 1 << 20
_PLACE_BITS = np.uint64(23)


@functools.cache
def _weights() -> np.ndarray:
    return np.random.default_rng(20_240).integers(1, 2**63, 4, np.uint64) | np.uint64(1)


def _window_keys(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its minimiser (hash bits over its place), and the hash of each gram."""
    n = len(data) - GRAM + 1
    value = np.zeros(n, np.uint64)
    data = np.ascontiguousarray(data)
    for k, weight in enumerate(_weights()):
        value = T.mix(value + np.ndarray((n,), "<u8", data, 8 * k, (1,)) * weight)
    place = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    least = (value & ~place) | np.arange(n, dtype=np.uint64)
    span, width = 1, length - GRAM + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least, value


def _runs(length: int):
    def make(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[int, Runs]]:
        ids = ids.to_numpy()
        for part in T.slices(texts, _PIECE):
            total = len(part.data)
            for first in range(0, max(1, total - length + 1), _PIECE):  # one piece, but for a very long text
                piece = part.data[first : first + _PIECE + length - 1]
                if len(piece) < length:
                    continue
                least, value = _window_keys(piece, length)
                bounds = np.clip(part.bounds - first, 0, len(piece))
                size = np.diff(bounds)
                inside = np.maximum(size - length + 1, 0)
                valid = np.repeat(np.tile([True, False], len(size)), np.stack([inside, size - inside], 1).ravel())
                valid = valid[: len(least)]
                change = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
                start = np.concatenate([[0], np.flatnonzero(change) + 1])
                stop = np.append(start[1:], len(least))
                keep = valid[start]
                start, stop = start[keep], stop[keep]
                gram = (least[start] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
                row = np.searchsorted(part.bounds, start + first, "right") - 1
                raw = piece.tobytes()
                # the minimiser's place in the string leads it
                lead = (gram - start).astype("<u2").tobytes()
                packed = [lead[2 * k : 2 * k + 2] + raw[a : b + length - 1] for k, (a, b) in enumerate(zip(start.tolist(), stop.tolist()))]
                yield len(piece), Runs(T.mix(value[gram] ^ np.uint64(0x9E37)), packed, ids[part.first + row], start + first - part.bounds[row])
    return make


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0x5851F42D4C957F2D
    forward, back = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    forward[0] = back[0] = 1
    return np.cumprod(forward), np.cumprod(back)


def repeated_windows(strings: list[bytes], length: int) -> np.ndarray:
    """For each window of the strings, in order: does an equal one start elsewhere?"""
    raw = b"".join(strings)
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(s) for s in strings])
    begin = np.cumsum(sizes) - sizes
    # cut behind a space, at a quarter of the pairs of bytes around it
    cut_here = np.zeros(len(data), bool)
    cut_here[2:] = ~T.NOT_SPACE[data[1:-1]] & ((data[:-2] * np.uint8(7) + data[2:] * np.uint8(13)) & 3 == 0)
    cut_here[begin] = True
    cuts = np.flatnonzero(cut_here)
    tokens = [raw[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(raw)])]
    ranks = {t: k + len(strings) for k, t in enumerate(sorted(set(tokens)))}
    owner = np.searchsorted(begin, cuts, "right") - 1
    place = np.arange(len(cuts)) + owner  # each string before left a closing symbol
    text = np.empty(len(cuts) + len(strings), np.int64)
    text[place] = [ranks[t] for t in tokens]
    text[np.searchsorted(cuts, begin + sizes) + np.arange(len(strings))] = np.arange(len(strings))
    rank = np.empty(len(text), np.int64)
    rank[suffix_order(text)] = np.arange(len(text))

    at = T.concatenated_ranges(begin, sizes - length + 1)
    # the next cut that no byte before the window decides
    token = np.minimum(np.searchsorted(cuts, at + 2), len(cuts) - 1)
    stop = np.where(cuts[token] >= at + 2, cuts[token], len(data))
    forward, back = _powers(2 * length)  # no string is longer
    spread = T.mix(np.arange(256, dtype=np.uint64))[data] * forward[T.concatenated_ranges(np.zeros(len(sizes), np.int64), sizes)]
    total = np.concatenate([[np.uint64(0)], np.cumsum(spread, dtype=np.uint64)])
    shift = back[T.concatenated_ranges(np.zeros(len(sizes), np.int64), sizes - length + 1)]
    whole = (total[at + length] - total[at]) * shift
    within = stop - at >= length
    stop = np.where(within, at, stop)
    head = np.where(within, whole, (total[stop] - total[at]) * shift + (stop - at).astype(np.uint64))
    following = np.where(within, 0, rank[place[token]])
    by = np.lexsort((following, head))
    same = whole[by[1:]] == whole[by[:-1]]
    found = np.zeros(len(at), bool)
    found[by[1:][same]] = True
    found[by[:-1][same]] = True
    return found


def _neighbours(strings: list[bytes], places: list[int], length: int) -> list[list[int]]:
    """Strings of one minimiser by what they can share.

    A window reaches at least half of what it has besides the minimiser to one side of it. So
    two strings with a window in common have that half, on the left or on the right, in
    common; strings that no chain of equal halves joins can be ordered apart.
    """
    half = (length - GRAM) // 2
    parent = list(range(len(strings)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k
    first: dict[tuple[int, bytes], int] = {}
    for k, (text, at) in enumerate(zip(strings, places)):
        sides = []
        if at >= half:
            sides.append((0, text[at - half : at]))
        if len(text) >= at + GRAM + half:
            sides.append((1, text[at + GRAM : at + GRAM + half]))
        for side in sides:
            other = root(first.setdefault(side, k))
            parent[root(k)] = other
    groups: dict[int, list[int]] = {}
    for k in range(len(strings)):
        groups.setdefault(root(k), []).append(k)
    return [g for g in groups.values() if len(g) > 1]


def _judge(length: int):
    def judge(bucket: Bucket):
        times = np.bincount(bucket.entry, minlength=len(bucket.packed))
        places = [p[0] | p[1] << 8 for p in bucket.packed]
        strings = [p[2:] for p in bucket.packed]
        sizes = np.array([len(s) for s in strings])
        windows = sizes - length + 1
        begin = np.cumsum(windows) - windows
        repeated = np.repeat(times > 1, windows)
        order = np.argsort(bucket.key, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket.key[order])) + 1
        group, held = [], 0

        def settle():
            nonlocal group, held
            if group:
                some = np.concatenate(group)
                found = repeated_windows([strings[k] for k in some.tolist()], length)
                repeated[T.concatenated_ranges(begin[some], windows[some])] |= found
            group, held = [], 0

        edges = np.concatenate([[0], cuts, [len(order)]])
        for a in np.flatnonzero(np.diff(edges) > 1).tolist():  # a lone string only repeats as a whole
            own = order[edges[a] : edges[a + 1]].tolist()
            for near in _neighbours([strings[k] for k in own], [places[k] for k in own], length):
                some = np.array([own[k] for k in near])
                group.append(some)
                held += int(sizes[some].sum())
                if held >= ORDER_BYTES:
                    settle()
        settle()
        # spans of repeated windows inside each string, then one row for each occurrence
        string = np.repeat(np.arange(len(sizes)), windows)
        hit = np.flatnonzero(repeated)
        if not len(hit):
            return hit, hit, hit
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (np.diff(hit) > 1) | (np.diff(string[hit]) > 0)
        head = hit[fresh]
        tail = hit[np.append(np.flatnonzero(fresh)[1:], len(hit)) - 1]
        of = string[head]
        offset, extent = head - begin[of], tail - head + length
        number = np.bincount(of, minlength=len(sizes))
        span = T.concatenated_ranges((np.cumsum(number) - number)[bucket.entry], number[bucket.entry])
        owner = np.repeat(np.arange(len(bucket.entry)), number[bucket.entry])
        return bucket.doc_id[owner], bucket.start[owner] + offset[span], extent[span]
    return judge


def _apply(batches: Iterator[pa.RecordBatch], length: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "first_id"))
        for doc_id, text, spans, first_id in zip(*columns):
            raw = text.encode()
            kept, at, n_spans = [], 0, 0
            if first_id is not None and len(raw) >= length:
                at, n_spans = len(raw), 1
            else:
                for k, span in enumerate(spans or []):
                    start = span["start"]
                    if start > at or not k:  # touching spans are one
                        kept.append(raw[at:start])
                        n_spans += 1
                    at = max(at, start + span["length"])
            kept.append(raw[at:])
            rest = b"".join(kept)
            row = [doc_id, len(raw), len(raw) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest]
            for column, value in zip(out, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def suffix_dedup(docs: DataFrame, length: int = 400, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) per document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs, ids = distinct_documents(docs)
    copies, rest, total = distinct_texts(docs)
    spans = cut(route(rest, total, SPREAD, _runs(length), _judge(length)))
    most = spans.selectExpr("max(size(spans)) AS n").first()[0] or 0
    marked = docs.join(checked_broadcast(copies, 48), "doc_id", "left").join(
        checked_broadcast(spans, 64 + 24 * most), "doc_id", "left")
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    found = marked.select("doc_id", "text", "spans", "first_id").mapInArrow(lambda b: _apply(b, length, with_text), columns)
    return with_own_ids(found, ids, "doc_id")
