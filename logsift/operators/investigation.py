"""From incidents and approved knowledge to ranked, cited hypotheses.

Incidents come as two tables: ``incidents`` (incident_id, log_text, [scope...]) and
``events`` (incident_id, pos, timestamp, service, severity, message). Every step groups
partial counts, so an incident with very many events is no single task's problem.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsift import constants as C
from logsift.functions import text as X
from logsift.operators.features import KNOWLEDGE, TextOptions
from logsift.operators.ordering import attach, last_before, top_per_group
from logsift.operators.retrieval import build_index, in_scope, search_batch

# Keywords sent to the tasks at once, with their causes.
KEYWORD_BYTES = 8 << 20


def incident_summary(events: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Affected service, counts, first and last time, without the templates."""
    key = [*scope, "incident_id"]
    present = F.col("service") != ""
    stamp = F.when(F.col("timestamp") != "", F.col("timestamp"))
    per_service = events.groupBy(*key, "service").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pos").alias("first_pos"),
        F.sum(X.is_error_message(F.col("message")).cast("int")).alias("errors"),
        F.min(stamp).alias("first_seen"),
        F.max(stamp).alias("last_seen"),
    )
    return per_service.groupBy(*key).agg(
        F.coalesce(
            F.max_by(
                F.when(present, F.col("service")),
                F.when(present, F.struct("n", -F.col("first_pos"))),
            ),
            F.lit("unknown"),
        ).alias("affected_service"),
        F.sum("n").alias("event_count"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("error_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def dominant_errors(events: DataFrame, k: int = 3, scope: Sequence[str] = ()) -> DataFrame:
    """The k most frequent error templates of an incident, first seen first on ties."""
    key = [*scope, "incident_id"]
    errors = events.filter(X.is_error_message(F.col("message"))).groupBy(
        *key, X.error_template(F.col("message")).alias("template")
    ).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    return top_per_group(errors, key, [F.desc("n"), F.asc("first_pos")], k).select(
        *key, "rank", "template", "n")


def keyword_table(knowledge: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Keywords of each cause, one row each: the fixed taxonomy plus tokens of labelled documents.

    Returns (scope..., cause, cause_order, seen, word); ``seen`` sorts a cause's words by their first place.
    ``knowledge`` needs ``doc_pos``.
    """
    scope = list(scope)
    spark = knowledge.sparkSession
    taxonomy = [
        (cause, order, -1, place, word)
        for order, (cause, words) in enumerate(C.ROOT_CAUSES.items())
        for place, word in enumerate(words)
    ]
    fixed = spark.createDataFrame(
        taxonomy, "cause string, cause_order bigint, doc_pos bigint, place int, word string")
    if scope:
        scopes = knowledge.select(*scope).distinct()
        words = F.array(*[
            F.struct(F.lit(c).alias("cause"), F.lit(o).cast("bigint").alias("cause_order"),
                     F.lit(d).cast("bigint").alias("doc_pos"), F.lit(p).alias("place"),
                     F.lit(w).alias("word"))
            for c, o, d, p, w in taxonomy])
        fixed = scopes.select(*scope, F.inline(words))
    empty = F.array().cast("array<string>")
    source = F.lower(F.array_join(
        F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce("symptoms", empty),
                 F.coalesce("tags", empty)), " "))
    labelled = knowledge.filter(F.coalesce("root_cause", F.lit("")) != "")
    own = labelled.select(
        *scope, F.col("root_cause").alias("cause"),
        (F.lit(len(C.ROOT_CAUSES)) + F.col("doc_pos")).alias("cause_order"),
        "doc_pos",
        F.posexplode(F.regexp_extract_all(source, F.lit(X.KEYWORD_TOKEN), F.lit(0))).alias("place", "word"),
    ).filter(~F.col("word").isin(list(C.COMMON_KEYWORDS)))
    return fixed.unionByName(own).groupBy(*scope, "cause", "word").agg(
        F.min("cause_order").alias("cause_order"),
        F.min(F.struct("doc_pos", "place")).alias("seen"))


def cause_keywords(knowledge: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """I2, nested form for reading: (scope..., cause, cause_order, keywords)."""
    return keyword_table(knowledge, scope).groupBy(*scope, "cause").agg(
        F.min("cause_order").alias("cause_order"),
        F.transform(F.sort_array(F.collect_list(F.struct("seen", "word"))), lambda s: s["word"])
        .alias("keywords"))


def keyword_hits(texts: DataFrame, table: DataFrame, key: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """How many different keywords of its wanted causes a text contains: (scope..., key..., cause, hits).

    ``texts``: scope, key, text, wanted (a few causes). One automaton finds the keywords of all causes in one pass
    over a text. Keywords are sent to the tasks in parts of ``KEYWORD_BYTES``; more than one part takes a pass each.
    """
    scope, key = list(scope), list(key)
    spark = texts.sparkSession
    words = table.select(*scope, "cause", "word")
    size = words.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("cause") + 16), F.lit(0))).first()[0]
    parts = -(-size // KEYWORD_BYTES) or 1
    rows = texts.select(*scope, *key, "text", "wanted")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*scope, *key))
    found = None
    for part in range(parts):
        some = words if parts == 1 else words.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == part)
        known: dict[str, list[tuple]] = {}
        for row in some.toArrow().to_pylist():  # at most KEYWORD_BYTES
            known.setdefault(row["word"], []).append((*[row[c] for c in scope], row["cause"]))
        hits = rows.mapInArrow(_counted_hits(spark.sparkContext.broadcast(known), scope, key), f"{kinds}, cause string, hits long")
        found = hits if found is None else found.unionByName(hits)
    return found if parts == 1 else found.groupBy(*scope, *key, "cause").agg(F.sum("hits").alias("hits"))


def _counted_hits(known, scope: list[str], key: list[str]):
    def work(batches: Iterator[pa.RecordBatch]):
        automaton = ahocorasick.Automaton()
        for word, causes in known.value.items():
            automaton.add_word(word, causes)
        if known.value:
            automaton.make_automaton()
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in scope]
            rows, causes, hits = [], [], []
            for k, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist())):
                own = tuple(n[k] for n in names)
                counted = {(*own, cause): 0 for cause in wanted or ()}
                # matches of one word are one object
                matched = {id(m): m for _, m in automaton.iter(text or "")} if known.value else {}
                for match in matched.values():
                    for cause in match:
                        if cause in counted:
                            counted[cause] += 1
                rows += [k] * len(counted)
                causes += [c[-1] for c in counted]
                hits += counted.values()
            kept = batch.select([*scope, *key]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(causes, pa.string()), pa.array(hits, pa.int64())], names=[*scope, *key, "cause", "hits"])
    return work


def knowledge_index(knowledge: DataFrame, *, scope: Sequence[str] = (),
                    options: TextOptions = KNOWLEDGE):
    """Searchable corpus; needs id, doc_pos and, for hybrid search, embedding."""
    text = X.knowledge_text(*[F.col(c) for c in ("title", "service", "resolution", "symptoms", "tags")])
    documents = knowledge.withColumn("text", text).withColumn("doc_id", F.col("id"))
    return build_index(documents, options, scope=scope, k=C.KNOWLEDGE_TOP_K)


def knowledge_evidence(
    incidents: DataFrame, index, *, semantic_weight: float | Sequence[float] = C.INVESTIGATION_SEMANTIC_WEIGHT,
    k: int = C.KNOWLEDGE_TOP_K,
) -> DataFrame:
    """Up to k documents per incident; those without any similarity are dropped.

    Several weights are searched in one product and keep their column ``semantic_weight``.
    """
    one = isinstance(semantic_weight, (int, float))
    queries = incidents.withColumnRenamed("incident_id", "query_id").withColumnRenamed("log_text", "text")
    found = search_batch(queries, index, k, semantic_weights=(semantic_weight,) if one else tuple(semantic_weight))
    keys = [*index.scope, "doc_id"]
    documents = index.documents.select(*keys, "kind", "title", "root_cause", "resolution", "steps")
    # texts and steps: joined, not broadcast by their number of rows
    return found.filter(F.col("score") > 0).join(documents, keys).select(
        *([] if one else ["semantic_weight"]), *index.scope, F.col("query_id").alias("incident_id"), "rank", F.col("doc_id").alias("id"), "kind", "title",
        "root_cause", "resolution", "steps", "score",
        F.round("score", 4).alias("hybrid_similarity"),
        F.round("semantic", 4).alias("semantic_similarity"),
        F.round("lexical", 4).alias("lexical_similarity"),
    )


def correlate_deployments(summary: DataFrame, deployments: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Incidents whose affected service was deployed, with that service's deployments
    counted and bounded (no time limit applies).

    Deployments are combined per service before the join; a popular service would
    otherwise pair every one of its incidents with every one of its deployments. The
    deployments themselves are ``deployment_context``, one row each, keyed by service.
    """
    per_service = deployments.groupBy(*scope, "service").agg(
        F.count(F.lit(1)).alias("deployments"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    affected = summary.select(*scope, "incident_id", F.col("affected_service").alias("service"))
    return attach(affected, per_service, [*scope, "service"])


def deployment_context(summary: DataFrame, deployments: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The deployments of all affected services."""
    services = summary.select(*scope, F.col("affected_service").alias("service")).distinct()
    return attach(deployments, services, [*scope, "service"], "left_semi")


def last_deployments(
    summary: DataFrame, deployments: DataFrame, scope: Sequence[str] = (), time: str = "deployed_at"
) -> DataFrame:
    """I3, as of the incident: the last deployment of the affected service at or before ``first_seen``.

    ``deployments``: scope, id, service, ``time`` (of the type of first_seen). Of several at one time the
    largest id counts. Incidents without one have nulls.
    """
    incidents = in_scope(summary, scope).select(
        *scope, F.col("affected_service").alias("service"), F.col("first_seen").alias("_time"), "incident_id")
    marks = in_scope(deployments, scope).select(*scope, "service", F.col(time).alias("_time"), "id")
    found = last_before(incidents, marks, [*scope, "service"], "_time", "_mark")
    return found.select(*scope, "incident_id", "service", F.col("_time").alias("first_seen"),
                        F.col("_mark.id").alias("deployment_id"), F.col("_mark._time").alias(time))


def affected_by_deployment(summary: DataFrame, deployments: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """I3 as a flag: a service counts once, however many deployments it had."""
    services = deployments.select(*scope, F.col("service").alias("affected_service")).distinct()
    flagged = services.withColumn("deployed", F.lit(True))
    return attach(summary, flagged, [*scope, "affected_service"], "left").withColumn(
        "deployed", F.coalesce("deployed", F.lit(False)))


def rank_hypotheses(
    incidents: DataFrame, evidence: DataFrame, keywords: DataFrame, deployed: DataFrame,
    *, minimum_evidence: float | Sequence[float] = C.MINIMUM_HYPOTHESIS_EVIDENCE, k: int = 3,
    scope: Sequence[str] = (), by: Sequence[str] = (),
) -> DataFrame:
    """I4: causes with enough evidence, scored by keywords, evidence and deployments.

    ``keywords``: ``keyword_table``. Only causes cited by the incident's own evidence can pass a positive threshold, so
    at most four (incident, cause) rows arise per incident. Several thresholds are cells
    of the evidence score and give a column ``minimum_evidence``; ``by`` are columns of ``evidence``
    that tell trials apart (semantic_weight).
    """
    one = isinstance(minimum_evidence, (int, float))
    thresholds = [float(minimum_evidence)] if one else [float(t) for t in minimum_evidence]
    if not thresholds or any(not 0.0 < t <= 1.0 for t in thresholds):
        raise ValueError("minimum_hypothesis_evidence must lie in (0, 1].")
    key = [*scope, "incident_id"]
    best = evidence.filter(F.col("root_cause").isNotNull()).groupBy(
        *by, *key, F.col("root_cause").alias("cause")
    ).agg(F.max("hybrid_similarity").alias("evidence_score"),
          F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda e: e["id"])
          .alias("evidence_ids"))
    best = best.filter(F.col("evidence_score") >= min(thresholds))
    wanted = best.groupBy(*key).agg(F.collect_set("cause").alias("wanted"))  # four at most for each search
    hits = keyword_hits(wanted.join(incidents.select(*key, F.col("log_text").alias("text")), key), keywords, ["incident_id"], scope)
    per_cause = keywords.groupBy(*scope, "cause").agg(F.min("cause_order").alias("cause_order"), F.count(F.lit(1)).alias("words"))
    rows = best.join(hits, [*key, "cause"]).join(deployed.select(*key, "deployed"), key, "left")
    rows = attach(rows, per_cause, [*scope, "cause"])
    score = (
        0.45 * (F.col("hits") / F.col("words")) + 0.40 * F.col("evidence_score")
        + 0.15 * F.when((F.col("cause") == C.DEPLOYMENT_CAUSE) & F.col("deployed"), 1.0).otherwise(0.0)
    )
    scored = rows.withColumn("confidence", F.round(F.least(score, F.lit(0.99)), 4))
    trial = list(by)
    if not one:
        reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("evidence_score"))
        scored, trial = scored.withColumn("minimum_evidence", F.explode(reached)), [*by, "minimum_evidence"]
    return top_per_group(
        scored, [*trial, *key], [F.desc("confidence"), F.asc("cause_order")], k
    ).select(*trial, *key, "rank", "cause", "confidence", "evidence_ids")


def plan_checks(
    evidence: DataFrame, hypotheses: DataFrame, keywords: DataFrame, k: int = 6, scope: Sequence[str] = ()
) -> DataFrame:
    """The first k distinct steps of relevant cited runbooks, in evidence order.

    A runbook is relevant if its cause is among the hypotheses or its title names a keyword of theirs.
    """
    key = [*scope, "incident_id"]
    wanted = hypotheses.groupBy(*key).agg(F.collect_set("cause").alias("wanted"))  # three at most
    books = evidence.filter(F.col("kind") == "runbook").join(wanted, key)
    titles = books.select(*key, "id", F.lower("title").alias("text"), "wanted")
    named = keyword_hits(titles, keywords, ["incident_id", "id"], scope).filter("hits > 0").select(*key, "id").distinct()
    books = books.join(named.withColumn("_named", F.lit(True)), [*key, "id"], "left")
    relevant = F.coalesce(F.array_contains("wanted", F.col("root_cause")), F.lit(False)) | F.coalesce("_named", F.lit(False))
    steps = books.filter(relevant).select(
        *key, F.col("rank").alias("book"), F.col("id").alias("source_id"),
        F.posexplode("steps").alias("place", "step"))
    first = steps.groupBy(*key, "step").agg(
        F.min(F.struct("book", "place", "source_id")).alias("at"))
    return top_per_group(first, key, [F.col("at.book"), F.col("at.place")], k).select(
        *key, "rank", "step", F.col("at.source_id").alias("source_id"))


def evidence_ledger(evidence: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The facts an explanation may cite, with the scope they belong to."""
    return evidence.filter(F.coalesce("id", F.lit("")) != "").select(
        *scope, "incident_id", "id", "kind", "title", "root_cause", "resolution", "steps")


def validate_citations(outputs: DataFrame, ledger: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """I8: adds ``reason`` (null if accepted) to explanations.

    ``outputs``: scope, output_id, incident_id, explanation, uncertainty, cited_evidence_ids.
    Evidence counts for the incident of its own scope only.
    """
    outputs, ledger = in_scope(outputs, scope), in_scope(ledger, scope)
    facts, own = [*scope, "incident_id", "id"], [*scope, "output_id"]
    cited = outputs.select(*own, "incident_id", F.explode("cited_evidence_ids").alias("id"))
    outside = cited.join(ledger.select(*facts), facts, "left_anti")
    flagged = outside.groupBy(*own).agg(F.count_distinct("id").alias("unsupported"))
    blank = (X.strip(F.coalesce("explanation", F.lit(""))) == "") | (
        X.strip(F.coalesce("uncertainty", F.lit(""))) == "")
    return outputs.join(flagged, own, "left").withColumn(
        "unsupported", F.coalesce("unsupported", F.lit(0).cast("bigint"))
    ).withColumn(
        "reason",
        F.when(F.col("cited_evidence_ids").isNull(), "no citations")
        .when(F.col("unsupported") > 0, "outside ledger")
        .when(blank, "incomplete"))


def architecture_documents(services: DataFrame, *keys: str) -> DataFrame:
    """One searchable document per service."""
    name, owner = X.strip(F.col("name")), X.strip(F.coalesce("owner", F.lit("")))
    empty = F.array().cast("array<string>")
    depends = X.unique_strings(F.coalesce("dependencies", empty))
    return services.select(
        *keys, F.concat(F.lit("ARCH-"), name).alias("id"), F.lit("architecture").alias("kind"),
        F.concat(F.lit("Service context for "), name).alias("title"), name.alias("service"),
        empty.alias("symptoms"), F.lit(None).cast("string").alias("root_cause"),
        X.strip(F.coalesce("description", F.lit(""))).alias("resolution"), empty.alias("steps"),
        X.unique_strings(F.concat(F.array(name, owner), depends)).alias("tags"),
        depends.alias("dependencies"))


def approved_fields(documents: DataFrame, *keys: str) -> DataFrame:
    """Only the fields an investigation uses, trimmed."""
    def clean(column: str, default: str = "") -> Column:
        return X.strip(F.coalesce(column, F.lit(default))).alias(column)

    def unique(column: str) -> Column:
        empty = F.array().cast("array<string>")
        return X.unique_strings(F.coalesce(column, empty)).alias(column)

    return documents.select(
        *keys, clean("id"), clean("kind"), clean("title"), clean("service", "shared"),
        unique("symptoms"), "root_cause", clean("resolution"), unique("steps"), unique("tags"))


def tenant_knowledge(services: DataFrame, documents: DataFrame, *keys: str) -> DataFrame:
    """Architecture documents and approved documents of each tenant."""
    return architecture_documents(services, *keys).unionByName(
        approved_fields(documents, *keys), allowMissingColumns=True)
