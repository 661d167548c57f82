"""Language identification with interpolated Kneser-Ney character models.

Texts are read as words of letters (in lower case) and marks, each between two spaces. A
model predicts every character of a word, its closing space included, from up to
``ORDER`` - 1 characters before it in the same word. The longest n-grams, and those that
begin a word, keep their counts; shorter ones count their distinct predecessors. Each
order is discounted by n1 / (n1 + 2 n2) and interpolated with the next shorter one, the last with the
uniform distribution over the alphabet of all languages.

Counts come from the whole text of every document that may be learnt from, but for one in
``CALIBRATION`` (by hash of the id), which is kept for calibration. Tasks add up n-grams
before they send them, and all that follows is grouped and joined by n-gram, so the model is a table that
grows with the corpus. Up to ``MODEL_CELLS`` n-grams times languages it is broadcast as
sorted hash arrays; above, the n-grams of the texts are joined with it. Both give the same costs.

A document's cross-entropy per language is the cost of its characters over their number;
the lowest wins (ties: the first language in order). The score is the winner's share of
exp(-entropy / temperature); temperature and the score below which a prediction counts as
``rejected`` are fitted on all calibration documents, on the driver up to ``MOST_CALIBRATED`` of them and as
grouped sums above: the threshold is the lowest at which accepted
predictions are wrong in at most ``most_wrong`` of the cases. The winner is named all the same.

Null, empty and letterless texts are ``und``, score 0, rejected; so is every text if there
is nothing to learn from. Rows without doc_id or lang are not learnt from; all rows are
predicted as they come, repeated ones too, and no other column is read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from logsift.llm import textbytes as T
from logsift.llm.shared import checked_broadcast, cut
from logsift.operators.ordering import running_totals

ORDER = 4
UNKNOWN = "und"
CALIBRATION = 16
#: Calibration documents whose costs the driver gets (a few numbers each).
MOST_CALIBRATED = 20_000
TEMPERATURES = np.geomspace(0.005, 2, 60)
#: N-grams times languages of a model that every worker holds (8 bytes each).
MODEL_CELLS = 1 << 22
#: N-grams that a task adds up before it sends them.
MOST_HELD = 1 << 19

_SPACE = 32
_GRAMS_SQL = "lang string, gram string, c long"
_alphabet: list[tuple[np.ndarray, np.ndarray]] = []


def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the character it is read as (32 between words), and whether it is a letter."""
    if not _alphabet:
        read, letter = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                read[k], letter[k] = ord(low) if len(low) == 1 else k, True
            elif unicodedata.category(c)[0] == "M":
                read[k] = k
        _alphabet.append((read, letter))
    return _alphabet[0]


def _hashed(codes: np.ndarray) -> np.ndarray:
    """64 bits of each row of ``ORDER`` code points; shorter n-grams begin with zeros."""
    value = np.full(len(codes), 0x2545F4914F6CDD1D, np.uint64)
    for j in range(codes.shape[1]):
        value = T.mix(value * T._MULTIPLY + codes[:, j].astype(np.uint64))
    return value


@dataclass
class Characters:
    """Predicted characters of strings: their n-grams, their string, letters by string."""

    codes: np.ndarray
    owner: np.ndarray
    letters: np.ndarray


def characters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Characters:
    """Of the byte spans (UTF-8, without line breaks) of ``data``."""
    size = end - start + 1
    stops = np.cumsum(size)
    joined = np.full(int(size.sum()), 10, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[stops - 1] = False
    joined[inside] = data[T.concatenated_ranges(start, end - start)]
    points = np.frombuffer(joined.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    read, letter = alphabet()
    owner = np.cumsum(points == 10) - (points == 10)
    letters = np.bincount(owner[letter[points]], minlength=len(start))
    points = read[points]
    # of several spaces the first; one before everything
    kept = (points != _SPACE) | np.append(False, points[:-1] != _SPACE)
    points, owner = np.append(np.uint32(_SPACE), points[kept]), owner[kept]
    place = np.arange(len(points))
    opened = np.maximum.accumulate(np.where(points == _SPACE, place, 0))  # the last space up to here
    codes = np.zeros((len(owner), ORDER), np.uint32)
    for back in range(ORDER):
        there = place[1:] - back
        seen = there >= opened[:-1]
        codes[seen, ORDER - 1 - back] = points[there[seen]]
    return Characters(codes, owner, letters)


def _strings(codes: np.ndarray) -> pa.Array:
    """N-grams of code points as strings."""
    used = codes != 0
    flat = codes[used]
    width = 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)
    raw = flat.astype("<u4").tobytes().decode("utf-32-le").encode()
    stops = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(used.sum(1))])]
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(raw)])


def _codes(strings: list[str]) -> np.ndarray:
    """Code points of n-grams, zeros before shorter ones."""
    sizes = np.array([len(s) for s in strings], np.int64)
    codes = np.zeros((len(strings), ORDER), np.uint32)
    codes[np.arange(ORDER) >= ORDER - sizes[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    return codes


def _counted(batches: Iterator[pa.RecordBatch]):
    """Longest n-grams and those that begin a word, by language, added up by task."""
    names: dict[str, int] = {}
    held: list[tuple] = []
    size = 0

    def merged():
        key, lang, codes, n = (np.concatenate(x) for x in zip(*held))
        _, first, own = np.unique(key, return_index=True, return_inverse=True)
        return key[first], lang[first], codes[first], np.bincount(own, weights=n).astype(np.int64)

    def sent():
        _, lang, codes, n = merged()
        known = pa.array(list(names), pa.string())
        for first in range(0, len(n), 1 << 16):
            some = slice(first, first + (1 << 16))
            yield pa.RecordBatch.from_arrays([known.take(pa.array(lang[some])), _strings(codes[some]), pa.array(n[some])], names=["lang", "gram", "c"])

    for batch in batches:
        langs = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.int64)
        for part in T.slices(batch.column("text")):
            found = T.words(part, T.LETTERS, lower=True)
            if not len(found.hash):
                continue
            own = langs[part.first : part.last][found.row]
            _, first, times = np.unique(T.mix(found.hash + T.mix(own.astype(np.uint64))), return_index=True, return_counts=True)
            read = characters(T.LOWER[part.data], found.start[first], found.end[first])
            lang = own[first][read.owner]
            key = T.mix(_hashed(read.codes) + T.mix(lang.astype(np.uint64)))
            key, one, at = np.unique(key, return_index=True, return_inverse=True)
            held.append((key, lang[one], read.codes[one], np.bincount(at, weights=times[read.owner], minlength=len(key))))
            size += len(key)
            if size > MOST_HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > MOST_HELD // 2:
                    yield from sent()
                    held, size = [], 0
    if held:
        yield from sent()


def _levels(grams: DataFrame) -> list[DataFrame]:
    """(lang, gram, c) by length of the n-gram: counts, or distinct predecessors."""
    levels: list[DataFrame] = [None] * (ORDER + 1)  # type: ignore[list-item]
    levels[ORDER] = grams.where(F.length("gram") == ORDER)
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
        levels[k] = cut(shorter.unionByName(grams.where(F.length("gram") == k)) if k > 1 else shorter)
    return levels


def kneser_ney(grams: DataFrame) -> tuple[DataFrame, float]:
    """(lang, gram, logp, back) of counted n-grams, and the log probability of any character.

    ``logp``: of the n-gram's last character after the others; ``back``: what a shorter context's
    probability is multiplied with, as a logarithm, when the n-gram is the context. Either may be null.
    """
    levels = _levels(grams)
    size = levels[1].select("gram").distinct().count()
    any_character = -float(np.log(size + 1))
    entries, lower = [], None
    for k in range(1, ORDER + 1):
        n1, n2 = (F.sum((F.col("c") == n).cast("double")) for n in (1, 2))
        discount = levels[k].groupBy("lang").agg(F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.coalesce(F.try_divide(n1, n1 + 2 * n2), F.lit(0.5)))).alias("d"))
        context = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
        # a context's followers: no more than there are characters
        inside = Window.partitionBy("lang", "context")
        level = (
            levels[k].join(checked_broadcast(cut(discount), 48), "lang").withColumn("context", context)
            .withColumn("total", F.sum("c").over(inside)).withColumn("back", F.col("d") * F.count("*").over(inside) / F.col("total"))
            .withColumn("suffix", F.substring("gram", 2, k - 1) if k > 1 else F.lit("")))
        if lower is None:
            level = level.withColumn("below", F.exp(F.lit(any_character)))
        else:
            level = level.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        level = cut(level.select("lang", "gram", "context", "back", (
            F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("below")).alias("p")))
        entries.append(level.select("lang", "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("back")))
        entries.append(level.groupBy("lang", F.col("context").alias("gram")).agg(F.lit(None).cast("double").alias("logp"), F.log(F.max("back")).alias("back")))
        lower = level
    table = entries[0]
    for other in entries[1:]:
        table = table.unionByName(other)
    return cut(table.groupBy("lang", "gram").agg(F.max("logp").alias("logp"), F.max("back").alias("back"))), any_character


def _entries(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        key = _hashed(_codes(batch.column("gram").to_pylist())).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c) for c in ("lang", "logp", "back"))], names=["key", "lang", "logp", "back"])


class HashArrays:
    """The models of all languages by sorted n-gram hash."""

    def __init__(self, rows: pa.Table, langs: list[str], any_character: float):
        key = rows["key"].to_numpy().view(np.uint64)
        self.keys, at = np.unique(key, return_inverse=True)
        lang = pc.index_in(rows["lang"], value_set=pa.array(langs)).to_numpy()
        self.logp = np.full((len(langs), len(self.keys)), np.nan, np.float32)
        self.back = np.zeros((len(langs), len(self.keys)), np.float32)
        for name, into in (("logp", self.logp), ("back", self.back)):
            value = rows[name].to_numpy()
            known = ~np.isnan(value)
            into[lang[known], at[known]] = value[known]
        self.any_character = any_character

    def _find(self, codes: np.ndarray) -> np.ndarray:
        key = _hashed(codes)
        order = np.argsort(key)  # neighbours in the array are looked up one after the other
        place = np.empty(len(key), np.int64)
        place[order] = np.minimum(np.searchsorted(self.keys, key[order]), len(self.keys) - 1)
        return np.where(self.keys[place] == key, place, -1)

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Minus log probability of each n-gram's last character, a row for each language."""
        total = np.zeros((len(self.logp), len(codes)))
        open_ = np.ones(total.shape, bool)
        size = (codes != 0).sum(1)
        for k in range(ORDER, 0, -1):
            some = codes.copy()
            some[:, : ORDER - k] = 0
            gram = self._find(some)
            some[:, 1:] = some[:, :-1].copy()  # the context: without the last character
            some[:, 0] = 0
            context = self._find(some)
            long_enough = size >= k
            for lang in range(len(total)):
                p = np.where((gram >= 0) & long_enough, self.logp[lang, gram], np.nan)
                here = open_[lang] & ~np.isnan(p)
                total[lang, here] += p[here]
                open_[lang] &= ~here
                more = open_[lang] & (context >= 0) & long_enough
                total[lang, more] += self.back[lang, context[more]]
        return -(total + open_ * self.any_character)


def _read(part: T.Slice):
    """Words of a slice by distinct string: (words, string of each, their characters)."""
    found = T.words(part, T.LETTERS, lower=True)
    _, first, own = np.unique(found.hash, return_index=True, return_inverse=True)
    return found, own, characters(T.LOWER[part.data], found.start[first], found.end[first])


_SUMS_SQL = "doc_id {kind}, letters long, n long, costs array<double>"


def _summed(batches: Iterator[pa.RecordBatch], model):
    """Letters, predicted characters and their cost by language of every text."""
    model = model.value
    for batch in batches:
        for part in T.slices(batch.column("text")):
            langs, rows = len(model.logp), len(part)
            letters, n, costs = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros((rows, langs))
            found, own, read = _read(part)
            if len(read.owner):
                key, first, at = np.unique(_hashed(read.codes), return_index=True, return_inverse=True)
                by_gram = model.costs(read.codes[first])
                strings = len(read.letters)
                for weights, into in ((read.letters, letters), (np.bincount(read.owner, minlength=strings), n)):
                    into += np.bincount(found.row, weights=weights[own], minlength=rows).astype(np.int64)
                for lang in range(langs):
                    by_string = np.bincount(read.owner, weights=by_gram[lang][at], minlength=strings)
                    costs[:, lang] = np.bincount(found.row, weights=by_string[own], minlength=rows)
            stops = np.arange(rows + 1, dtype=np.int32) * langs
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(part.first, rows), pa.array(letters), pa.array(n), pa.ListArray.from_arrays(pa.array(stops), pa.array(costs.ravel()))],
                names=["doc_id", "letters", "n", "costs"])


def _pairs(batches: Iterator[pa.RecordBatch]):
    """Every text's n-grams and how often they occur; one empty n-gram carries the letters."""
    for batch in batches:
        for part in T.slices(batch.column("text"), T.SLICE_BYTES // 8):
            found, own, read = _read(part)
            keys = batch.column("text_key").slice(part.first, len(part))
            letters = np.bincount(found.row, weights=read.letters[own], minlength=len(part)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array([""] * len(part)), pa.array(letters)], names=["text_key", "gram", "times"])
            # the characters of every word, by way of its string
            order = np.argsort(read.owner, kind="stable")
            sizes = np.bincount(read.owner, minlength=len(read.letters))
            heads = np.cumsum(sizes) - sizes
            at = order[T.concatenated_ranges(heads[own], sizes[own])]
            row = np.repeat(found.row, sizes[own])
            if not len(at):
                continue
            key = _hashed(read.codes[at])
            _, first, times = np.unique(T.mix(key + T.mix(row.astype(np.uint64))), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[first])), _strings(read.codes[at[first]]), pa.array(times)], names=["text_key", "gram", "times"])


@dataclass
class LanguageModel:
    """Kneser-Ney models of some languages, and how their entropies become a score."""

    table: DataFrame  # lang, gram, logp, back
    langs: list[str]
    any_character: float
    temperature: float = 0.1
    threshold: float = 0.0


def _joined_costs(grams: DataFrame, model: LanguageModel) -> DataFrame:
    """(gram, costs): the costs of ``HashArrays`` by joins, for models that no worker holds."""
    asked = grams.withColumn("lang", F.explode(F.array(*map(F.lit, model.langs)))).withColumn("size", F.length("gram"))
    for k in range(1, ORDER + 1):
        suffix = F.expr(f"right(gram, {k})")
        for name, key in (("logp", suffix), ("back", F.substring(suffix, 1, k - 1) if k > 1 else F.lit(""))):
            other = model.table.where(F.col(name).isNotNull()).select("lang", F.col("gram").alias("_key"), F.col(name).alias(f"{name}{k}"))
            asked = asked.withColumn("_key", F.when(F.col("size") >= k, key)).join(other, ["lang", "_key"], "left").drop("_key")
    value = F.lit(model.any_character)
    for k in range(1, ORDER + 1):
        value = F.when(F.col("size") >= k, F.coalesce(f"logp{k}", F.coalesce(f"back{k}", F.lit(0.0)) + value)).otherwise(value)
    cost = F.max(F.struct("lang", (-value).alias("cost"))).alias("one")
    by_lang = asked.groupBy("gram", "lang").agg(cost).groupBy("gram").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return by_lang.select("gram", F.col("all.cost").alias("costs"))


def sums(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, letters, n, costs: a row for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    grams = model.table.agg(F.count_distinct("gram")).first()[0]
    if grams * len(model.langs) <= MODEL_CELLS:
        rows = model.table.mapInArrow(_entries, "key long, lang string, logp double, back double").toArrow()
        arrays = docs.sparkSession.sparkContext.broadcast(HashArrays(rows, model.langs, model.any_character))
        return docs.mapInArrow(lambda b: _summed(b, arrays), _SUMS_SQL.format(kind=docs.schema["doc_id"].dataType.simpleString()))
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    pairs = cut(docs.select(key.alias("text_key"), "text").distinct().mapInArrow(_pairs, "text_key string, gram string, times long"))
    costs = cut(_joined_costs(pairs.where("gram <> ''").select("gram").distinct(), model))
    letters = F.sum(F.when(F.col("gram") == "", F.col("times")).otherwise(0))
    n = F.sum(F.when(F.col("gram") == "", 0).otherwise(F.col("times")))
    by_text = pairs.join(costs, "gram", "left").groupBy("text_key").agg(
        letters.alias("letters"), n.alias("n"),
        F.array(*[F.coalesce(F.sum(F.col("times") * F.col("costs")[k]), F.lit(0.0)) for k in range(len(model.langs))]).alias("costs"))
    return docs.select("doc_id", key.alias("text_key")).join(by_text, "text_key").select("doc_id", "letters", "n", "costs")


def predicted(summed: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected from sums of costs."""
    read = F.col("letters") > 0
    entropies = F.transform("costs", lambda x: x / F.col("n"))
    least = F.array_min("entropies")
    shares = F.aggregate("entropies", F.lit(0.0), lambda a, x: a + F.exp((least - x) / F.lit(model.temperature)))
    rows = summed.withColumn("entropies", F.when(read, entropies))
    score = F.coalesce(1 / shares, F.lit(0.0))
    return rows.select(
        "doc_id",
        F.when(read, F.array(*map(F.lit, model.langs))[F.array_position("entropies", least).cast("int") - 1]).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        score.alias("score"), least.alias("entropy"), (~read | (score < model.threshold)).alias("rejected"))


def fit_languages(docs: DataFrame, learn: Column | None = None, most_wrong: float = 0.01) -> LanguageModel | None:
    """Models from the rows of ``docs`` (doc_id, text, lang) for which ``learn`` holds; None without any."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if learn is None else learn))
    aside = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)), F.lit(CALIBRATION)) == 0
    grams = cut(rows.where(~aside).select("lang", "text").mapInArrow(_counted, _GRAMS_SQL).groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    langs = sorted(r.lang for r in grams.select("lang").distinct().collect())
    if not langs:
        return None
    table, any_character = kneser_ney(grams)
    model = LanguageModel(table, langs, any_character)
    held = rows.where(aside & F.col("lang").isin(langs)).select(F.col("lang").alias("doc_id"), "text")
    found = cut(sums(held, model).where("letters > 0").select(F.col("doc_id").alias("lang"), "n", "costs"))
    many = found.count()
    if many > MOST_CALIBRATED:
        model.temperature, model.threshold = calibrated_rows(found, langs, most_wrong)
    elif many:
        few = found.toPandas()
        model.temperature, model.threshold = calibrated(
            np.vstack(few["costs"].to_numpy()) / few["n"].to_numpy()[:, None], np.array([langs.index(x) for x in few["lang"]]), most_wrong)
    return model


def calibrated(entropies: np.ndarray, truth: np.ndarray, most_wrong: float) -> tuple[float, float]:
    """Temperature of least log loss, and the lowest threshold with at most ``most_wrong`` of the accepted wrong."""
    fall = entropies.min(1, keepdims=True) - entropies
    own = fall[np.arange(len(truth)), truth]
    temperature = min(TEMPERATURES, key=lambda t: float(np.mean(np.log(np.exp(fall / t).sum(1)) - own / t)))
    score, right = 1 / np.exp(fall / temperature).sum(1), entropies.argmin(1) == truth
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    # equal scores are accepted together
    last = np.append(score[order][1:] != score[order][:-1], True)
    fine = np.flatnonzero((wrong <= most_wrong) & last)
    return float(temperature), float(score[order][fine[-1]]) if len(fine) else 1.0


def calibrated_rows(found: DataFrame, langs: list[str], most_wrong: float) -> tuple[float, float]:
    """``calibrated`` for any number of rows (lang, n, costs), a table read from the shared folder."""
    entropies, least = F.transform("costs", lambda x: x / F.col("n")), F.array_min("entropies")
    truth = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")
    rows = found.select(entropies.alias("entropies"), truth.alias("truth")).select(
        F.transform("entropies", lambda x: least - x).alias("fall"), "truth", (F.array_position("entropies", least) != F.col("truth")).cast("int").alias("wrong"))
    total = lambda t: F.aggregate("fall", F.lit(0.0), lambda a, x: a + F.exp(x / F.lit(float(t))))
    own = F.col("fall")[F.col("truth") - 1]
    losses = rows.agg(*[F.avg(F.log(total(t)) - own / F.lit(float(t))) for t in TEMPERATURES]).first()
    temperature = float(TEMPERATURES[int(np.argmin(losses))])
    # equal scores are accepted together
    scores = rows.select((1 / total(temperature)).alias("score"), "wrong").groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("wrong").alias("wrong"))
    upto = running_totals(scores, [F.desc("score")], {"n": "all_n", "wrong": "all_wrong"})
    threshold = upto.where(F.col("all_wrong") / F.col("all_n") <= most_wrong).agg(F.min("score")).first()[0]
    return temperature, 1.0 if threshold is None else threshold


def identify_languages(docs: DataFrame, learn: Column | None = None, most_wrong: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected of every row of ``docs``, learnt from some of them."""
    model = fit_languages(docs, learn, most_wrong)
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    return predicted(sums(docs, model), model)
