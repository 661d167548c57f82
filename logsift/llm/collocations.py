"""Phrase collocations by multikey quicksort of suffix pointers.

Texts (A-Z in lower case) are cut into pieces at ``.,;:!?`` and line ends, pieces into words
at spaces and tabs. A suffix is a word with the words after it in its piece, up to ``longest`` of
them; words are known by 64 bits of a hash of language and word, 0 ends a suffix.

1. Tasks count words by language and send them added up, in compressed blobs by bucket; words that occur ``least`` times or more
   mark a bitmap of bounded size, which every task gets. A word whose bit is not set can be in no
   candidate, so it ends suffixes before it.
2. Suffixes are routed by their first two words to buckets, equal ones of a task once with
   their number, in blobs where the most frequent words are small numbers by frequency. A bucket sorts pointers to them with a three-way multikey quicksort, word after word:
   the weight of an equal partition is the count of its words as a phrase, and a partition lighter than
   ``least`` is abandoned. Buckets are sized from the number of words; a bucket keeps
   each distinct suffix once. Pairs that are frequent in the tasks' samples of pairs are split:
   their suffixes go by all their words to buckets that count longer phrases only,
   and the pair itself travels as one row. The samples only decide how work is spread.
3. Candidates meet the counts of their parts (first k words, the rest) by joins. A candidate that
   a longer one explains is dropped: a longer one of one more word suffices, since every
   phrase between the two is a candidate too and occurs at least as often as the longer.
4. The first ``top`` of each language: those that reach the score and count at place ``top`` get
   their words, then the final rank. Scores are exact, in decimals of 38 digits.

A null lang is ``und``, a null text empty; repeated rows count again; only text and lang are
read. Equal score and count are ordered by the phrase's UTF-8 bytes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from logsift.llm import textbytes as T
from logsift.llm.shared import checked_broadcast, cut

#: Words of the corpus for each bucket of suffixes, bytes of text for each bucket of words.
BUCKET_WORDS = 1 << 19
WORD_BYTES = 16 << 20
#: Suffixes that leave a task together; distinct words that a task adds up.
FLUSH = 1 << 19
MOST_HELD = 1 << 18
#: Bits of the bitmap of frequent words, at most.
MOST_BITS = 1 << 27
#: Words that travel as numbers by frequency instead of hashes, at most.
COMMON = 1 << 18
#: Pairs that are split, at most, and how often one must come up in a slice's sample.
SPLIT_PAIRS = 1 << 16
SAMPLE = 1 << 14
OFTEN = 16

_END = T._table([(0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)])
_WORD = _END & T._table([(0x20, 0x20), (0x09, 0x09)])
_LANGS: dict[str, int] = {}


def _language(name: str) -> int:
    if name not in _LANGS:
        if len(_LANGS) > 10_000:
            _LANGS.clear()
        _LANGS[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
    return _LANGS[name]


def _read(batches: Iterator[pa.RecordBatch]):
    """Slices: language of each text, its data, its words with their hashes, and which follow the one before."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        hashes = np.array([_language(x) for x in langs], np.uint64)
        for part in T.slices(batch.column("text")):
            found = T.words(part, _WORD, lower=True)
            if not len(found.hash):
                continue
            data = T.LOWER[part.data]
            key = np.maximum(T.mix(found.hash ^ hashes[part.first : part.last][found.row]), np.uint64(1))
            ends = np.cumsum(~_END[data], dtype=np.int32)  # a word's first byte ends nothing
            piece = ends[found.start]
            joined = np.append(False, (found.row[1:] == found.row[:-1]) & (piece[1:] == piece[:-1]))
            yield langs[part.first : part.last], data, found, key, joined


def _binary(keys: np.ndarray, width: int = 8) -> pa.Array:
    n = keys.nbytes // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


_BLOB_SQL = "bucket long, payload binary"
_COUNTED = ("key", "lang", "word", "c")
_COUNTED_SQL = "key binary, lang string, word string, c long"


def _table(lang: pa.Array, word: pa.Array, n: np.ndarray) -> bytes:
    """Words and their numbers as a compressed Arrow message; sorted words compress well."""
    batch = pa.RecordBatch.from_arrays([lang, word, pa.array(n)], names=["lang", "word", "c"])
    batch = batch.take(pc.sort_indices(batch, [("lang", "ascending"), ("word", "ascending")]))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _counted(batches: Iterator[pa.RecordBatch], buckets: int):
    """Blobs of words by language with their number; in buckets below zero, of pairs that a sample finds often."""
    held: list[tuple] = []
    size = 0

    def merged():
        key, n = np.concatenate([h[0] for h in held]), np.concatenate([h[3] for h in held])
        some, first, own = np.unique(key, return_index=True, return_inverse=True)
        at = pa.array(first)
        return some, pa.concat_arrays([h[1] for h in held]).take(at), pa.concat_arrays([h[2] for h in held]).take(at), np.bincount(own, weights=n).astype(np.int64)

    def sent():
        key, lang, word, n = merged()
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for first, last in _runs(bucket[order]):
            some = order[first:last]
            yield _blob(int(bucket[some[0]]), _table(lang.take(pa.array(some)), word.take(pa.array(some)), n[some]))

    for langs, data, found, key, joined in _read(batches):
        some, first, n = np.unique(key, return_index=True, return_counts=True)
        start, size_ = found.start[first], found.end[first] - found.start[first]
        offsets = np.concatenate([[0], np.cumsum(size_)]).astype(np.int32)
        raw = data[T.concatenated_ranges(start, size_)]
        word = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])
        held.append((some, pa.array(langs, pa.string()).take(pa.array(found.row[first])), word, n))
        size += len(some)
        at = np.flatnonzero(joined[1:])
        at = at[:: max(1, len(at) // SAMPLE)]
        pair, often = np.unique(T.mix(key[at] * T._MULTIPLY + key[at + 1]), return_counts=True)
        pair, often = pair[often >= OFTEN], often[often >= OFTEN].astype(np.int64)
        bucket = -1 - (pair % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(bucket).tolist():
            yield _blob(b, pair[bucket == b].tobytes() + often[bucket == b].tobytes())
        if size > MOST_HELD:
            held = [merged()]
            size = len(held[0][0])
            if size > MOST_HELD // 2:
                yield from sent()
                held, size = [], 0
    if held:
        yield from sent()


def _blob(bucket: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([payload], pa.binary())], names=["bucket", "payload"])


def _keys(lang: pa.Array, word: pa.Array) -> np.ndarray:
    """The keys of words, as ``_read`` has them."""
    offsets = np.frombuffer(word.buffers()[1], np.int32)[word.offset : word.offset + len(word) + 1].astype(np.int64)
    found = T.hash_spans(np.frombuffer(word.buffers()[2], np.uint8), offsets[:-1], offsets[1:])
    coded = lang.dictionary_encode()
    hashes = np.array([_language(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return np.maximum(T.mix(found ^ hashes[coded.indices.to_numpy()]), np.uint64(1))


def _added(batches: Iterator[pa.RecordBatch]):
    """Blobs sorted by bucket: a row for each word (or pair) of a bucket."""
    for bucket, payloads in _by_bucket(batches):
        if bucket < 0:
            raw = [np.frombuffer(p, np.uint64).reshape(2, -1) for p in payloads]
            key, own = np.unique(np.concatenate([r[0] for r in raw]), return_inverse=True)
            n = np.bincount(own, weights=np.concatenate([r[1] for r in raw])).astype(np.int64)
            lang = word = pa.nulls(len(key), pa.string())
        else:
            table = pa.concat_tables([pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(p)).read_all() for p in payloads]).combine_chunks()
            lang, word = (table[c].combine_chunks() for c in ("lang", "word"))
            key, first, own = np.unique(_keys(lang, word), return_index=True, return_inverse=True)
            n = np.bincount(own, weights=table["c"].to_numpy()).astype(np.int64)
            lang, word = lang.take(pa.array(first)), word.take(pa.array(first))
        for first in range(0, len(key), 1 << 15):
            yield pa.RecordBatch.from_arrays(
                [_binary(key[first : first + (1 << 15)]), lang.slice(first, 1 << 15), word.slice(first, 1 << 15), pa.array(n[first : first + (1 << 15)])], names=_COUNTED)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    current, waiting = None, []
    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
            if bucket != current and waiting:
                yield current, waiting
                waiting = []
            current = bucket
            waiting.append(payload.as_py())
    if waiting:
        yield current, waiting


def _bits(batches: Iterator[pa.RecordBatch], bits: int):
    """The words' places in the bitmap, by block of 2^16 bits."""
    for batch in batches:
        key = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint64)
        place = np.unique(key & np.uint64(bits - 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(place >> 16), pa.array((place & 0xFFFF).astype(np.int32))], names=["block", "place"])


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Places sorted by block: one row of 2^13 bytes for each block."""
    current, bitmap = None, np.zeros(1 << 16, bool)

    def row():
        return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([np.packbits(bitmap).tobytes()], pa.binary())], names=["block", "bitmap"])

    for batch in batches:
        block, place = batch.column("block").to_numpy(), batch.column("place").to_numpy()
        for first, last in _runs(block):
            if block[first] != current:
                if current is not None:
                    yield row()
                current, bitmap = int(block[first]), np.zeros(1 << 16, bool)
            bitmap[place[first:last]] = True
    if current is not None:
        yield row()


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    heads = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist() if len(values) else []
    return list(zip(heads, [*heads[1:], len(values)]))


def frequent_bitmap(frequent: DataFrame) -> np.ndarray:
    """A bit for every frequent word's hash; at most ``MOST_BITS``, packed."""
    bits = 1 << 16
    number = frequent.count()
    while bits < min(MOST_BITS, 16 * number):
        bits *= 2
    rows = (
        frequent.select("key").mapInArrow(lambda b: _bits(b, bits), "block long, place int")
        .repartition("block").sortWithinPartitions("block").mapInArrow(_blocks, "block long, bitmap binary").collect())
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in rows:
        bitmap[row.block << 13 : (row.block + 1) << 13] = np.frombuffer(row.bitmap, np.uint8)
    return bitmap


def _distinct(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal suffixes (rows of ``words``) once, with the sum of their numbers."""
    _, first, own = np.unique(T.fold(words), return_index=True, return_inverse=True)
    return words[first], np.bincount(own, weights=n, minlength=len(first)).astype(np.int64)


class CommonWords:
    """Numbers, from 1 by frequency, of the most frequent words; others keep their hashes."""

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], (order + 1).astype(np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word, ``_OTHER`` if it has none, 0 for the end."""
        if not len(self.keys):
            return np.where(keys == 0, 0, _OTHER).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], np.where(keys == 0, 0, _OTHER)).astype(np.uint32)

    def names(self, keys: np.ndarray) -> np.ndarray:
        """What a word is called from here on: its number, or its hash."""
        number = self.find(keys)
        return np.where(number == _OTHER, _other(keys), number)


_OTHER = np.uint32(0xFFFFFFFF)


def _other(keys: np.ndarray) -> np.ndarray:
    return np.maximum(keys, np.uint64(1 << 32))  # apart from all numbers


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first: small numbers compress well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _encoded(words: np.ndarray, numbers: np.ndarray, n: np.ndarray) -> bytes:
    """A blob of suffixes by their words' numbers; words without one follow as hashes."""
    others = [words[numbers[:, j] == _OTHER, j] for j in range(words.shape[1])]
    raw = np.array([len(n), *map(len, others)], np.int64).tobytes() + _planes(n.astype(np.int64)) + b"".join(
        _planes(np.ascontiguousarray(x)) for x in numbers.T) + b"".join(x.tobytes() for x in others)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _decoded(blob: bytes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by the words' names, and how often they occur."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, *others = np.frombuffer(raw, np.int64, 1 + longest).tolist()
    at = 8 * (1 + longest)

    def values(kind) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize
        found = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel()
        at += n * size
        return found

    times = values(np.int64)
    numbers = [values(np.uint32) for _ in range(longest)]
    words = np.zeros((n, longest), np.uint64)
    for j in range(longest):
        words[:, j] = numbers[j]
        words[numbers[j] == _OTHER, j] = _other(np.frombuffer(raw, np.uint64, others[j], at))
        at += 8 * others[j]
    return words, times


def _suffixes(batches: Iterator[pa.RecordBatch], longest: int, buckets: int, known):
    """Blobs of suffixes by bucket: (bucket, payload). Buckets from ``buckets`` on are of split pairs."""
    bitmap, split, common = known.value
    bits = np.uint64(len(bitmap) * 8 - 1)
    held: list[np.ndarray] = []
    size = 0

    def sent():
        words, n = _distinct(np.concatenate(held), np.ones(size))
        pair = T.mix(words[:, 0] * T._MULTIPLY + words[:, 1])
        bucket = (pair % np.uint64(buckets)).astype(np.int64)
        at = np.minimum(np.searchsorted(split, pair), max(0, len(split) - 1))
        hot = np.flatnonzero(split[at] == pair) if len(split) else np.zeros(0, np.int64)
        if len(hot) and longest > 2:
            rest = words[hot].copy()
            rest[:, 2:] = 0
            rest, sums = _distinct(rest, n[hot])
            longer = words[hot, 2] != 0
            own = (T.fold(words[hot, :3]) % np.uint64(buckets)).astype(np.int64) + buckets
            cold = np.setdiff1d(np.arange(len(n)), hot)
            words, n, bucket = (
                np.concatenate([words[cold], words[hot][longer], rest]), np.concatenate([n[cold], n[hot][longer], sums]),
                np.concatenate([bucket[cold], own[longer], (T.mix(rest[:, 0] * T._MULTIPLY + rest[:, 1]) % np.uint64(buckets)).astype(np.int64)]))
        numbers = common.find(words.ravel()).reshape(words.shape)
        order = np.lexsort((*numbers.T[::-1], bucket))  # neighbours alike: they compress well
        words, numbers, n, bucket = words[order], numbers[order], n[order], bucket[order]
        runs = _runs(bucket)
        for first in range(0, len(runs), 64):
            some = runs[first : first + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[a]) for a, _ in some]), pa.array([_encoded(words[a:b], numbers[a:b], n[a:b]) for a, b in some], pa.binary())], names=["bucket", "payload"])

    for _, _, _, key, joined in _read(batches):
        place = key & bits
        often = (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 > 0
        words = np.zeros((len(key), longest), np.uint64)
        words[:, 0] = key
        goes = often
        for j in range(1, min(longest, len(key))):
            goes = goes[: len(key) - j] & joined[j:] & often[j:]
            words[: len(key) - j, j] = np.where(goes, key[j:], np.uint64(0))
        words = words[words[:, 1] != 0]
        held.append(words)
        size += len(words)
        if size > FLUSH:
            yield from sent()
            held, size = [], 0
    if size:
        yield from sent()


def multikey_quicksort(words: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, pointer, weight) of the phrases that begin the suffixes ``words`` and weigh ``least`` or more.

    Three-way partitioning of pointers, all partitions of a round at once: of an equal
    partition the next word is compared, the lesser and greater ones stay at theirs. The
    weight of an equal partition is the count of the phrase; a partition too light is
    abandoned, with all phrases in it, and so is one whose suffixes have ended.
    """
    pointer = np.arange(len(n))
    heads, depth = np.zeros(1 if len(n) else 0, np.int64), np.zeros(1 if len(n) else 0, np.int64)
    while len(pointer):
        sizes = np.diff(np.append(heads, len(pointer)))
        own = np.repeat(np.arange(len(heads)), sizes)
        word = words[pointer, depth[own]]
        three = np.sort(np.stack([word[heads], word[heads + sizes // 2], word[heads + sizes - 1]]), axis=0)
        pivot = three[1]
        kind = (word > pivot[own]).astype(np.int64) + (word >= pivot[own])  # 0 less, 1 equal, 2 greater
        part = own * 3 + kind
        weight = np.bincount(part, weights=n[pointer], minlength=3 * len(heads)).astype(np.int64)
        length = np.repeat(depth, 3)
        equal = np.arange(len(weight)) % 3 == 1
        length[equal] += 1
        ended = equal & (np.repeat(pivot, 3) == 0)
        heavy = (weight >= least) & ~ended
        # where partitions begin once their members stand together
        count = np.bincount(part, minlength=len(weight))
        found = np.flatnonzero(heavy & equal)
        if len(found):
            member = np.empty(len(weight), np.int64)
            member[part] = pointer  # any member stands for the partition
            for d in np.unique(length[found]).tolist():
                some = found[length[found] == d]
                yield d, member[some], weight[some]
        on = heavy & (length < words.shape[1])
        count = np.where(on, count, 0)
        start = np.cumsum(count) - count
        moved = np.empty(int(count.sum()), np.int64)
        for side in range(3):
            some = np.flatnonzero(on[part] & (kind == side))
            before = np.cumsum(count[side::3]) - count[side::3]  # of the same side in partitions before
            moved[start[part[some]] + np.arange(len(some)) - before[own[some]]] = pointer[some]
        pointer, heads, depth = moved, start[on], length[on]


def _phrases(batches: Iterator[pa.RecordBatch], longest: int, buckets: int, least: int):
    """Phrases of two words or more with their counts: (phrase, c)."""
    current, held, size, limit = None, [], 0, FLUSH

    def done():
        words, n = _distinct(np.concatenate([w for w, _ in held]), np.concatenate([c for _, c in held]))
        for length, pointer, weight in multikey_quicksort(words, n, least):
            if length >= (3 if current >= buckets else 2):
                yield pa.RecordBatch.from_arrays([_binary(words[pointer, :length], 8 * length), pa.array(weight)], names=["phrase", "c"])

    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
            if bucket != current and held:
                yield from done()
                held, size, limit = [], 0, FLUSH
            current = bucket
            held.append(_decoded(payload.as_py(), longest))
            size += len(held[-1][1])
            if size > limit:
                held = [_distinct(np.concatenate([w for w, _ in held]), np.concatenate([c for _, c in held]))]
                size = len(held[0][1])
                limit = 2 * size + FLUSH
    if held:
        yield from done()


def _named(batches: Iterator[pa.RecordBatch], known):
    """Words under the names that phrases use."""
    for batch in batches:
        key = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint64)
        yield pa.RecordBatch.from_arrays([_binary(known.value[2].names(key)), *(batch.column(c) for c in _COUNTED[1:])], names=_COUNTED)


def phrase_counts(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, lang, word, c) of all words, the same of words and (phrase, c) of phrases with ``least`` occurrences.

    A phrase is the keys (8 bytes each) of its two to ``longest`` words; in the last two tables the key is a
    number for the ``COMMON`` most frequent words, which every task gets, and a hash for all others.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    parts = (texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // WORD_BYTES + 1
    most = 20 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = cut(
        texts.mapInArrow(lambda b: _counted(b, parts), _BLOB_SQL)
        .repartition(min(2 * parts, most), "bucket").sortWithinPartitions("bucket").mapInArrow(_added, _COUNTED_SQL))
    words = counted.where("word IS NOT NULL")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    pairs = counted.where("word IS NULL").orderBy(F.desc("c"), "key").limit(SPLIT_PAIRS).select("key").collect()
    split = np.sort(np.array([np.frombuffer(r.key, np.uint64)[0] for r in pairs], np.uint64))
    often = words.where(F.col("c") >= least)
    top = often.orderBy(F.desc("c"), "key").limit(COMMON).select("key").toArrow().column("key").to_pylist()
    common = CommonWords(np.frombuffer(b"".join(top), np.uint64))
    known = spark.sparkContext.broadcast((frequent_bitmap(often), split, common))
    buckets = total // BUCKET_WORDS + 1
    frequent = cut(often.mapInArrow(lambda b: _named(b, known), _COUNTED_SQL))
    return words, frequent, cut(
        texts.mapInArrow(lambda b: _suffixes(b, longest, buckets, known), _BLOB_SQL)
        .repartition(min(2 * buckets, most), "bucket").sortWithinPartitions("bucket")
        .mapInArrow(lambda b: _phrases(b, longest, buckets, least), "phrase binary, c long"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, explained: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of every language of ``docs`` (lang, text).

    ``a``: occurrences of the phrase; the score is floor(1000000 a^2 / (l r)) of the cut into first words (l) and rest (r)
    with the lowest score (ties: the earliest cut); ``n``: words of the language. A phrase is dropped if
    100 * f(longer) >= ``explained`` * a for a longer candidate that holds it.
    """
    if longest < 2 or least < 1:
        raise ValueError("longest must be 2 or more, least 1 or more.")
    words, often, phrases = phrase_counts(docs, longest, least)
    counts = cut(often.select(F.col("key").alias("part"), F.col("c").alias("f"), "lang").unionByName(
        phrases.select(F.col("phrase").alias("part"), F.col("c").alias("f"), F.lit(None).cast("string").alias("lang"))))
    size = (F.octet_length("phrase") / 8).cast("int")
    cuts = phrases.select("phrase", F.col("c").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("phrase", "a", "k", F.expr("substring(phrase, 1, 8 * k)").alias("first"), F.expr("substring(phrase, 8 * k + 1)").alias("rest"))
    side = checked_broadcast(counts, 80)
    cuts = cuts.join(side.select(F.col("part").alias("first"), F.col("f").alias("l"), "lang"), "first")
    cuts = cuts.join(side.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest")
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    score = F.expr(f"({whole('a')} * {whole('a')} * cast(1000000 as decimal(7, 0))) div ({whole('l')} * {whole('r')})")
    scored = cuts.withColumn("score", score).groupBy("phrase").agg(
        F.first("a").alias("a"), F.max("lang").alias("lang"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.array(F.expr("substring(phrase, 1, octet_length(phrase) - 8)"), F.expr("substring(phrase, 9)"))
    longer = phrases.where(F.octet_length("phrase") > 16).select(F.explode(inner).alias("phrase"), "c").groupBy("phrase").agg(F.max("c").alias("longer"))
    kept = cut(
        scored.join(longer, "phrase", "left").where(F.coalesce(100 * F.col("longer") < explained * F.col("a"), F.lit(True)))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    # what reaches the last place, before words are known
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    last = kept.select("lang", "score", "a", place.alias("place")).where(F.col("place") <= top).where(F.col("place") == top)
    last = checked_broadcast(cut(last.select("lang", F.col("score").alias("last_score"), F.col("a").alias("last_a"))), 64)
    reached = F.coalesce((F.col("score") > F.col("last_score")) | ((F.col("score") == F.col("last_score")) & (F.col("a") >= F.col("last_a"))), F.lit(True))
    few = cut(kept.join(last, "lang", "left").where(reached).drop("last_score", "last_a"))
    keys = F.expr("transform(sequence(1, octet_length(phrase), 8), x -> substring(phrase, x, 8))")
    named = (
        few.select("lang", "phrase", F.posexplode(keys).alias("at", "key"))
        .join(often.select("key", "word"), "key").groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("said")))
    totals = checked_broadcast(cut(words.groupBy("lang").agg(F.sum("c").alias("n"))), 48)
    rows = few.join(named, "phrase").join(totals, "lang").withColumn("phrase", F.array_join("said.word", " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
