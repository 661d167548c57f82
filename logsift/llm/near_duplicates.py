"""MinHash near-duplicates: one permutation, optimal densification, banded star edges.

Documents are sets of word shingles; two are linked when 100 * intersection size reaches
``percent`` * union size. Equal sets become one class first, so exact copies, however many,
cost one representative. A representative's shingle hashes are sorted once; the top of a
hash names its bin, so the first hash of each bin is the bin's minimum (one permutation),
and an empty bin borrows from a bin drawn for it by hashing until a filled one is found
(optimal densification). ``ROWS`` bins make a band, whose hash is a bucket key.

In a bucket the smallest document is the hub of a star: n rows give n - 1 candidate edges,
never all pairs. Candidates are confirmed on the full shingle sets of whole texts. Where
confirmed edges leave a bucket in several components, the members outside its largest
component meet the bucket once more, block by block, inside a task, as whole shingle sets;
a pair is compared in the first bucket that it shares, and only linked pairs leave it. A
pair of similarity 0.8 shares no band in one of 8 million cases.

Null and empty texts have no shingles, are linked with nothing and form their own
component. Equal rows of one id count once; different texts of one id are documents of
their own, each with a row, the one with the smaller digest being the smaller document.
Rows without id have no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsift.llm import textbytes as T
from logsift.llm.shared import checked_broadcast, components, cut, distinct_documents, with_own_ids

BANDS = 40
ROWS = 5
BINS = BANDS * ROWS
#: Shingles in a block of sets that meet another in a task.
BLOCK_SHINGLES = 65_536

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                     ("fingerprint", pa.binary()), ("signature", pa.binary())])
_SKETCH_SQL = "doc_id long, n_shingles long, fingerprint binary, signature binary"


def shingle_sets(part: T.Slice, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, the row of each, and their number per row."""
    found = T.words(part, T.NOT_SPACE, lower=True)
    value, first = T.grams(found, size)
    row = found.row[first]
    short = np.flatnonzero((found.per_row > 0) & (found.per_row < size))
    if len(short):  # fewer words: the whole sequence is one shingle
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            there = found.per_row[short] > j
            at = found.first_of_row[short[there]] + j
            whole[there] = T.mix(whole[there] * np.uint64(31) + found.hash[at] + np.uint64(j + 1))
        value, row = np.concatenate([value, whole]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], row[keep], np.bincount(row[keep], minlength=len(part))


def signatures(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Densified one-permutation signatures of sorted sets, one row of bins each."""
    cell = row * BINS + (((value >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    signature = np.zeros(rows * BINS, np.uint32)
    filled = np.zeros(rows * BINS, bool)
    signature[cell[first]] = T.mix(value[first]).astype(np.uint32)
    filled[cell[first]] = True
    present = np.zeros(rows, bool)
    present[row] = True
    empty = np.flatnonzero(~filled & np.repeat(present, BINS))
    attempt = 1
    while len(empty):
        drawn = T.mix((empty % BINS).astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt))
        source = empty - empty % BINS + (drawn % np.uint64(BINS)).astype(np.int64)
        ok = filled[source]
        signature[empty[ok]] = signature[source[ok]]
        empty, attempt = empty[~ok], attempt + 1
    return signature.reshape(rows, BINS)


def _sketch(batches: Iterator[pa.RecordBatch], size: int):
    def work(batch):
        for part in T.slices(batch.column("text")):
            value, row, count = shingle_sets(part, size)
            signed = signatures(value, row, len(part))
            starts = np.concatenate([[0], np.cumsum(count)])
            sums = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(value), dtype=np.uint64)])
            again = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(value ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
            prints = np.stack([sums[starts[1:]] - sums[starts[:-1]], again[starts[1:]] - again[starts[:-1]]], 1)
            yield pa.table([
                batch.column("doc_id").slice(part.first, len(part)),
                pa.array(count.astype(np.int64)),
                pa.array([p.tobytes() for p in prints], pa.binary()),
                pa.array([s.tobytes() if n else b"" for s, n in zip(signed, count)], pa.binary()),
            ], schema=_SKETCH)
    return T.mapped(batches, work, _SKETCH)


def band_hashes(signed: np.ndarray) -> np.ndarray:
    some = signed.astype(np.uint64).reshape(-1, ROWS)
    some = T.mix(some + (np.arange(len(some)) % BANDS).astype(np.uint64)[:, None] * np.uint64(1 << 33))
    return T.fold(some).view(np.int64).reshape(-1, BANDS)


def _bands(batches: Iterator[pa.RecordBatch]):
    schema = pa.schema([("doc_id", pa.int64()), ("bucket", pa.int64())])

    def work(batch):
        if not batch.num_rows:
            return
        signed = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, BINS)
        for first in range(0, len(signed), 4096):
            ids = np.repeat(batch.column("doc_id").to_numpy()[first : first + 4096], BANDS)
            yield pa.table([pa.array(ids), pa.array(band_hashes(signed[first : first + 4096]).ravel())], schema=schema)
    return T.mapped(batches, work, schema)


def _whole(batches: Iterator[pa.RecordBatch], size: int):
    """Bands and upper hash halves of the full shingle sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("bands", pa.binary()), ("shingles", pa.binary())])

    def work(batch):
        for part in T.slices(batch.column("text")):
            value, row, count = shingle_sets(part, size)
            bands = band_hashes(signatures(value, row, len(part)))
            halves = np.split((value >> np.uint64(32)).astype(np.uint32), np.cumsum(count)[:-1])
            yield pa.table([batch.column("doc_id").slice(part.first, len(part)), pa.array([b.tobytes() for b in bands], pa.binary()),
                            pa.array([h.tobytes() for h in halves], pa.binary())], schema=schema)
    return T.mapped(batches, work, schema)


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batch):
        for first in range(0, batch.num_rows, 256):
            some = batch.slice(first, 256)
            left, right = some.column("text_a").to_pylist(), some.column("text_b").to_pylist()
            distinct = {t: k for k, t in enumerate(dict.fromkeys(left + right))}
            sets: list[np.ndarray] = []
            for part in T.slices(pa.array(list(distinct), pa.large_string())):
                value, _, count = shingle_sets(part, size)
                sets += np.split(value, np.cumsum(count)[:-1])
            linked = []
            for x, y in zip(left, right):
                x, y = sets[distinct[x]], sets[distinct[y]]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    linked.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.table([some.column("a"), some.column("b")], schema=schema).filter(pa.array(linked))
    return T.mapped(batches, work, schema)


def _meet(batches: Iterator[pa.RecordBatch], percent: int):
    """Blocks of sets that share a bucket: pairs of two components that reach the similarity.

    Half hashes can only make an intersection look larger by chance; pairs are confirmed later.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def unpack(rows):
        ids, comps = (np.array([r[k] for r in rows], np.int64) for k in ("doc_id", "component"))
        bands = np.frombuffer(b"".join(r["bands"] for r in rows), np.int64).reshape(-1, BANDS)
        return ids, comps, bands, [np.frombuffer(r["shingles"], np.uint32) for r in rows]

    def work(batch):
        columns = (batch.column(c).to_pylist() for c in ("bucket", "largest", "outer_block", "inner_block"))
        for bucket, largest, outer, inner in zip(*columns):
            a, a_comp, a_bands, a_sets = unpack(outer)
            b, b_comp, b_bands, b_sets = unpack(inner)
            b_size = np.array([len(x) for x in b_sets])
            for k, own in enumerate(a_sets):
                ok = (b_comp != a_comp[k]) & ((b_comp == largest) | (b > a[k]))
                ok &= 100 * np.minimum(b_size, len(own)) >= percent * np.maximum(b_size, len(own))
                place = int(np.argmax(a_bands[k] == bucket))
                ok &= np.argmax(b_bands == a_bands[k], axis=1) == place
                some = np.flatnonzero(ok)
                if not len(some):
                    continue
                all_of = np.concatenate([b_sets[i] for i in some.tolist()])
                there = own[np.minimum(np.searchsorted(own, all_of), len(own) - 1)] == all_of
                size = b_size[some]
                common = np.add.reduceat(there.astype(np.int64), np.cumsum(size) - size)
                linked = some[100 * (common + 1) >= percent * (len(own) + size - common - 1)]
                yield pa.table([pa.array(np.minimum(b[linked], a[k])), pa.array(np.maximum(b[linked], a[k]))], schema=schema)
    return T.mapped(batches, work, schema)


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links; ``kept`` marks it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, ids = distinct_documents(docs)
    sketched = cut(docs.mapInArrow(lambda b: _sketch(b, shingle), _SKETCH_SQL))
    key = ["n_shingles", "fingerprint"]
    classes = sketched.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"))
    member = cut(
        sketched.where("n_shingles > 0").join(classes, key)
        .select("doc_id", "n_shingles", "class_id", F.when(F.col("doc_id") == F.col("class_id"), F.col("signature")).alias("signature"))
    )
    banded = cut(
        member.where("signature IS NOT NULL").select("doc_id", "signature")
        .mapInArrow(_bands, "doc_id long, bucket long")
        .groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n"))
        .where("n > 1").select("bucket", "hub")
    )
    rows = cut(
        member.where("signature IS NOT NULL").select("doc_id", "signature")
        .mapInArrow(_bands, "doc_id long, bucket long")
        .join(checked_broadcast(banded, 64), "bucket").distinct()
    )
    candidates = cut(rows.select("doc_id").distinct())
    texts = cut(docs.join(checked_broadcast(candidates, 32), "doc_id", "left_semi"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return (
            pairs.where("a <> b").distinct()
            .join(texts.selectExpr("doc_id AS b", "text AS text_b"), "b")
            .join(texts.selectExpr("doc_id AS a", "text AS text_a"), "a")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(lambda batches: _confirm(batches, shingle, percent), "a long, b long")
        )

    stars = cut(confirmed(rows.selectExpr("hub AS a", "doc_id AS b")))
    labels = components(stars)
    # buckets whose rows are still in several components
    placed = cut(
        rows.join(labels, rows.doc_id == labels.node, "left")
        .select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    )
    unresolved = (
        placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high").select("bucket")
    )
    sizes = placed.join(unresolved, "bucket", "left_semi").groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    open_rows = cut(placed.join(largest, "bucket"))
    open_texts = texts.join(checked_broadcast(cut(open_rows.select("doc_id").distinct()), 32), "doc_id", "left_semi")
    whole = open_texts.mapInArrow(lambda batches: _whole(batches, shingle), "doc_id long, bands binary, shingles binary")
    sized = open_rows.join(checked_broadcast(cut(whole.select("doc_id", (F.octet_length("shingles") / 4).alias("n"))), 48), "doc_id")
    # blocks of about BLOCK_SHINGLES, dealt by a hash of the id
    blocks = sized.groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    entry = F.struct("doc_id", "component", "bands", "shingles")
    block = F.expr("pmod(xxhash64(doc_id), blocks)")
    met = cut(open_rows.join(blocks, "bucket").join(whole, "doc_id"))
    inner = met.groupBy("bucket", block.alias("block")).agg(F.collect_list(entry).alias("inner_block"))
    outer = met.where("component <> largest").groupBy("bucket", "largest", block.alias("block_of")).agg(
        F.collect_list(entry).alias("outer_block"))
    pairs = outer.join(inner, "bucket").select("bucket", "largest", "outer_block", "inner_block").mapInArrow(
        lambda batches: _meet(batches, percent), "a long, b long")
    labels = components(stars.unionByName(cut(confirmed(pairs.distinct()))))

    everyone = sketched.select("doc_id", "n_shingles").join(member.select("doc_id", "class_id"), "doc_id", "left")
    component = F.coalesce("component", "class_id", "doc_id")
    found = everyone.join(labels, F.col("class_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
    return with_own_ids(found, ids, "doc_id", "component_id")
