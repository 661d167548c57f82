"""Minimiser routing: runs of consecutive windows travel as one string to one bucket.

A window is a fixed number of consecutive units (bytes or words) of one text. Its minimiser
is its smallest k-gram under a hash order, a function of the window's content alone, so
equal windows of any two texts carry the same minimiser. Neighbouring windows mostly share
theirs: such a run travels as one packed string to the bucket of the minimiser, and every
window of the corpus is in exactly one run.

Packed strings leave a task in blobs, one per bucket, compressed, each distinct string
once with the list of its occurrences: a passage that thousands of documents share is sent
once per blob. Buckets are sized in bytes of the whole input, so the number of buckets
grows with the input and a task's memory doesn't. Whole copies of a text are set aside
before (see ``distinct_texts``), so a hot group of copies never reaches a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from logsift.llm.shared import checked_broadcast, cut

BUCKET_BYTES = 6 << 20
#: Bytes of texts whose runs are packed together.
FLUSH_BYTES = 6 << 20
BLOB_SQL = "bucket long, payload binary"
_BLOB = pa.schema([("bucket", pa.int64()), ("payload", pa.binary())])


@dataclass
class Runs:
    """Runs of windows: minimiser, packed string, text id, first unit within the text."""

    key: np.ndarray
    packed: list[bytes]
    doc_id: np.ndarray
    start: np.ndarray


@dataclass
class Bucket:
    """Distinct (minimiser, string) pairs of a bucket and their occurrences."""

    key: np.ndarray
    packed: list[bytes]
    entry: np.ndarray  # of each occurrence: index into the two lists above
    doc_id: np.ndarray
    start: np.ndarray


def _encode(key, packed, entry, doc_id, start) -> bytes:
    head = np.array([len(packed), len(entry)], np.int64)
    sizes = np.array([len(p) for p in packed], np.uint32)
    raw = b"".join([head.tobytes(), key.astype(np.uint64).tobytes(), sizes.tobytes(), entry.astype(np.uint32).tobytes(),
                    doc_id.astype(np.int64).tobytes(), start.astype(np.int64).tobytes(), *packed])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _decode(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (strings, rows), at = np.frombuffer(raw, np.int64, 2), 16
    out = []
    for kind, n in ((np.uint64, strings), (np.uint32, strings), (np.uint32, rows), (np.int64, rows), (np.int64, rows)):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    key, sizes, entry, doc_id, start = out
    ends = at + np.cumsum(sizes, dtype=np.int64)
    packed = [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
    return key, packed, entry, doc_id, start


def blobs(runs: list[Runs], buckets: int) -> Iterator[pa.Table]:
    """Pack runs by bucket, each distinct string of a bucket once."""
    if not runs:
        return
    key = np.concatenate([r.key for r in runs])
    if not len(key):
        return
    packed = [p for r in runs for p in r.packed]
    doc_id, start = np.concatenate([r.doc_id for r in runs]), np.concatenate([r.start for r in runs])
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    names, payloads = [], []
    for some in np.split(order, cuts):
        index: dict[bytes, int] = {}
        entry = np.fromiter((index.setdefault(packed[i], len(index)) for i in some.tolist()), np.int64, len(some))
        first = np.unique(entry, return_index=True)[1]
        names.append(int(bucket[some[0]]))
        payloads.append(_encode(key[some[first]], list(index), entry, doc_id[some], start[some]))
    yield pa.table([pa.array(names), pa.array(payloads, pa.binary())], schema=_BLOB)


def _merged(payloads: Iterator[bytes]) -> Bucket:
    index: dict[bytes, int] = {}
    keys, entries, ids, starts = [], [], [], []
    for blob in payloads:
        key, packed, entry, doc_id, start = _decode(blob)
        place = np.empty(len(packed), np.int64)
        for k, p in enumerate(packed):
            known = len(index)
            place[k] = index.setdefault(p, known)
            if place[k] == known:
                keys.append(key[k])
        entries.append(place[entry])
        ids.append(doc_id)
        starts.append(start)
    return Bucket(np.array(keys, np.uint64), list(index), np.concatenate(entries), np.concatenate(ids), np.concatenate(starts))


def route(texts: DataFrame, total_bytes: int, spread: float, make_runs: Callable, judge: Callable) -> DataFrame:
    """(doc_id, spans) of the found spans: pairs of int64 (start, length), as binary.

    ``make_runs(pa.Array of ids, pa.Array of texts)`` yields (bytes of text, Runs);
    ``judge(Bucket)`` returns doc ids, starts and lengths. ``spread`` is how many packed
    bytes leave per byte of text.
    """
    spark = texts.sparkSession
    buckets = max(1, int(total_bytes * spread / BUCKET_BYTES) + 1)
    tasks = max(1, min(buckets, 20 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def send(batches):
        waiting, size = [], 0
        for batch in batches:
            for n, runs in make_runs(batch.column("doc_id"), batch.column("text")):
                waiting.append(runs)
                size += n
                if size >= FLUSH_BYTES:
                    for table in blobs(waiting, buckets):
                        yield from table.to_batches()
                    waiting, size = [], 0
        for table in blobs(waiting, buckets):
            yield from table.to_batches()

    def receive(batches):
        for payloads in _by_bucket(batches):
            ids, starts, lengths = judge(_merged(payloads))
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(starts), pa.array(lengths)], names=["doc_id", "start", "length"])

    found = (
        texts.mapInArrow(send, BLOB_SQL)
        .repartition(tasks, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(receive, "doc_id long, start long, length long")
    )
    # a task sends a text's spans of many runs: they meet again by text
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Payloads of one bucket after the other; batches are sorted by bucket."""
    current, waiting = None, []
    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
            if bucket != current and waiting:
                yield waiting
                waiting = []
            current = bucket
            waiting.append(payload.as_py())
    if waiting:
        yield waiting


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Copies set aside: (doc_id, first_id) of texts with copies; all but the later copies; bytes.

    ``first_id`` is the smallest id with the same bytes; it has a row too. Only digests are
    shuffled.
    """
    digests = cut(docs.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size")))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copies = cut(digests.join(firsts, "digest").select("doc_id", "first_id"))
    total = digests.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    later = copies.where("doc_id <> first_id").select("doc_id")
    rest = docs.join(checked_broadcast(later, 32), "doc_id", "left_anti")
    return copies, rest, total
