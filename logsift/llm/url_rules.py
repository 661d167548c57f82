"""URL filters: a sort-merge range join of page keys with nested rule intervals.

The host's labels in reverse order, each closed by a byte below every host character, make
a canonical key in which a rule's host and all its subdomains are one interval, and two
rules' intervals are nested or apart. Pages and rules are cut into key ranges: the cuts are
quantiles of the pages' keys (with the page id as tie-break, so one host with a third of
all pages fills many ranges), and a rule goes to each range its interval meets. Only rules
that enclose a cut go to more than one range: as many as hosts can nest. A task then sweeps
its range in key order and keeps a stack of the open rules; a page's rules are those on the
stack whose path is a prefix of its path. The longest rule (host and path together) wins;
of two equal ones a block wins.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case.
Path: then up to ``?``, ``#`` or the end. A null url or one without ``://`` has neither and
gets the default verdict, as does a page that no rule fits. Each row is judged on its own,
so repeated rows and null ids stay. Rules with a null or empty host fit nothing.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsift.llm.shared import cut

#: Rows (pages and rules) that a range is meant to hold.
RANGE_ROWS = 100_000
_CLOSE = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``a.example.org`` as ``org\\x01example\\x01a\\x01``."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), _CLOSE), F.lit(_CLOSE))


def _sweep(batches: Iterator[pa.RecordBatch], default: str):
    """Rows in order of (part, key, kind): rules of a key come before its pages."""
    part, stack = None, []  # open rules: (key, {path: (rule, verdict)}, longest path first)
    for batch in batches:
        ids, rules, verdicts, take = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("part", "key", "kind", "path", "rule", "verdict"))
        for k, (at, key, kind, path, rule, verdict) in enumerate(zip(*columns)):
            if at != part:
                part, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                known = stack[-1][1].setdefault(path, (rule, verdict))
                if verdict == "block" and known[1] != "block":
                    stack[-1][1][path] = (rule, verdict)
                continue
            best = None
            for _, by_path in stack:
                for size in {len(p) for p in by_path} if len(by_path) > 8 else ():
                    found = by_path.get(path[:size]) if size <= len(path) else None
                    best = _better(best, found)
                if len(by_path) <= 8:
                    for prefix, found in by_path.items():
                        if path.startswith(prefix):
                            best = _better(best, found)
            take.append(k)
            rules.append(best[0] if best else None)
            verdicts.append(best[1] if best else default)
        some = batch.take(pa.array(take, pa.int64()))
        ids = some.column("page_id")
        yield pa.RecordBatch.from_arrays(
            [ids, some.column("host"), some.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
            names=["page_id", "host", "path", "rule", "verdict"])


def _better(a, b):
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda r: (len(r[0]), r[1] == "block", r[0]))


def _place(batches: Iterator[pa.RecordBatch], cuts: list[tuple[str, int]]):
    """Adds the range of each page, and one row per range that a rule's interval meets."""
    low, high = -(2**63), 2**63 - 1
    for batch in batches:
        take, part = [], []
        for k, (key, mixed, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "mixed", "kind")))):
            first = last = bisect.bisect_right(cuts, (key, mixed if kind else low))
            if not kind:
                last = bisect.bisect_right(cuts, (key + "\U0010ffff", high))
            for at in range(first, last + 1):
                take.append(k)
                part.append(at)
        some = batch.take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *some.columns], names=["part", *some.schema.names])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page; ``rules``: host, path, verdict."""
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = cut(keyed.withColumn("key", F.when(F.col("host") == "", F.lit("")).otherwise(host_key(F.col("host"))))
                .withColumn("mixed", F.xxhash64("path", "page_id")))
    rows = keyed.count()
    parts = max(-(-rows // RANGE_ROWS), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a sample in proportion to the ranges places the cuts, as a range partitioner's does
    every = max(1, rows // (parts * 64))
    sample = keyed.where(F.pmod(F.xxhash64("mixed"), F.lit(every)) == 0).select("key", "mixed").toLocalIterator()
    sample = sorted((r.key, r.mixed) for r in sample)
    cuts = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    nothing = F.lit(None).cast("string")
    page_rows = keyed.select("key", "mixed", F.lit(1).alias("kind"), "page_id", "host", "path", nothing.alias("rule"), nothing.alias("verdict"))
    rule_rows = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host <> ''")
        .select(host_key(F.col("host")).alias("key"), F.lit(0).cast("long").alias("mixed"), F.lit(0).alias("kind"),
                F.lit(None).cast("long").alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    )
    shape = "key string, mixed long, kind int, page_id long, host string, path string, rule string, verdict string"
    return (
        page_rows.unionByName(rule_rows).mapInArrow(lambda b: _place(b, cuts), "part int, " + shape)
        .repartition(parts, "part").sortWithinPartitions("part", "key", "kind")
        .mapInArrow(lambda b: _sweep(b, default), "page_id long, host string, path string, rule string, verdict string")
    )
