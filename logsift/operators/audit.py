"""Audit, feedback and profile tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from logsift import constants as C
from logsift.functions import text as X


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``failed``, the names of the rules a row breaks (empty when valid).

    A rule that evaluates to null counts as broken.
    """
    failed = F.array(*[
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ])
    return df.withColumn("failed", F.array_compact(failed))


def length_between(column: str, low: int, high: int) -> Column:
    return F.length(column).between(low, high)


# ---- fixed values: patterns of the request rules -----------------------------------
ORGANIZATION = "^[a-z0-9][a-z0-9-]*$"
SERVICE_NAME = "^[a-zA-Z0-9][a-zA-Z0-9_-]*$"


def incident_rules() -> dict[str, Column]:
    events = F.col("events")
    return {
        "incident_id": length_between("incident_id", 1, 100),
        "events": F.size(events).between(1, 500),
        "message": F.forall(events, lambda e: F.coalesce(
            F.length(e["message"]).between(1, 4000), F.lit(False))),
    }


def _optional(column: str, rule: Column) -> Column:
    return F.col(column).isNull() | rule


def investigation_rules() -> dict[str, Column]:
    return incident_rules() | {
        "organization_id": _optional(
            "organization_id",
            length_between("organization_id", 2, 100) & F.col("organization_id").rlike(ORGANIZATION)),
        "triage_recommendation": F.col("triage_recommendation").isin(
            C.LIKELY_ANOMALY, C.NEEDS_REVIEW),
    }


def knowledge_rules() -> dict[str, Column]:
    def limited(column: str, high: int) -> Column:
        return F.coalesce(F.size(column), F.lit(0)) <= high
    return {
        "id": length_between("id", 2, 100),
        "kind": F.col("kind").isin("incident", "runbook"),
        "title": length_between("title", 3, 500),
        "service": F.length("service") <= 100,
        "symptoms": limited("symptoms", 50),
        "root_cause": _optional("root_cause", F.length("root_cause") <= 200),
        "resolution": F.length("resolution") <= 5000,
        "steps": limited("steps", 30),
        "tags": limited("tags", 50),
    }


def deployment_rules() -> dict[str, Column]:
    return {
        "id": length_between("id", 2, 100),
        "service": length_between("service", 2, 100),
        "commit": F.length("commit") <= 100,
        "timestamp": F.length("timestamp") <= 100,
        "summary": F.length("summary") <= 2000,
    }


def service_rules() -> dict[str, Column]:
    return {
        "name": length_between("name", 2, 100) & F.col("name").rlike(SERVICE_NAME),
        "description": F.length("description") <= 2000,
        "owner": F.length("owner") <= 200,
        "dependencies": F.coalesce(F.size("dependencies"), F.lit(0)) <= 50,
    }


def profile_rules() -> dict[str, Column]:
    return {
        "organization_id": length_between("organization_id", 2, 100)
        & F.col("organization_id").rlike(ORGANIZATION),
        "display_name": length_between("display_name", 2, 200),
        "description": F.length("description") <= 2000,
        "services": F.size("services").between(1, 100),
        "knowledge": F.coalesce(F.size("knowledge"), F.lit(0)) <= 1000,
        "deployments": F.coalesce(F.size("deployments"), F.lit(0)) <= 1000,
    }


def feedback_rules() -> dict[str, Column]:
    """The constraints of the feedback table."""
    return {
        "final_anomaly_label": _optional(
            "final_anomaly_label",
            F.col("final_anomaly_label").isin("ANOMALY", "NORMAL", "UNCERTAIN")),
        "usefulness_rating": _optional(
            "usefulness_rating", F.col("usefulness_rating").between(1, 5)),
    }


def identified_decisions(decisions: DataFrame, batch: str) -> DataFrame:
    """A stable id per (incident, source, batch), so a retried append adds nothing."""
    return decisions.withColumn(
        "decision_id", F.xxhash64("incident_id", "source", F.lit(batch))
    ).withColumn("batch_id", F.lit(batch))


def append_decisions(decisions: DataFrame, path: str, batch: str) -> None:
    """Append once per batch; a rerun of the batch replaces its own folder."""
    identified_decisions(decisions, batch).withColumn(
        "created_at", F.current_timestamp()
    ).drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def append_feedback(feedback: DataFrame, path: str, quarantine: str) -> None:
    """Valid rows to ``path``, the others with their broken rules to ``quarantine``."""
    checked = split_valid(feedback, feedback_rules()).withColumn("created_at", F.current_timestamp())
    ok = F.size("failed") == 0
    checked.filter(ok).drop("failed").write.mode("append").parquet(path)
    checked.filter(~ok).write.mode("append").parquet(quarantine)


def last_per_key(incoming: DataFrame, key: str, *sequence: str) -> DataFrame:
    """One row per key, the last one by sequence; combined before the shuffle."""
    rest = [c for c in incoming.columns if c != key]
    return incoming.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_r")).select(key, "_r.*")


def upsert_profiles(
    current: DataFrame, incoming: DataFrame, now: Column, key: str = "organization_id"
) -> DataFrame:
    """The next snapshot: new keys at version 1, known ones replaced and counted up.

    ``incoming`` holds one row per key (see ``last_per_key``).
    """
    fields = [c for c in current.columns
              if c not in (key, "knowledge_version", "created_at", "updated_at")]
    new = incoming.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_in"))
    joined = current.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    replaced = F.col("_in").isNotNull()
    return joined.select(
        key,
        *[F.when(replaced, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        F.when(F.col("_old").isNull(), 1)
        .when(replaced, F.col("knowledge_version") + 1)
        .otherwise(F.col("knowledge_version")).cast("int").alias("knowledge_version"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(replaced, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def incident_listing(incidents: DataFrame) -> DataFrame:
    """B16."""
    return incidents.select("incident_id", "is_anomaly", "root_cause")


def lookup_incident(incidents: DataFrame, incident_id) -> DataFrame:
    """One incident, or none."""
    return incidents.filter(F.col("incident_id") == F.lit(incident_id)).limit(1)


def decision_queue(
    decisions: DataFrame, recommendation: str | None = None, source: str | None = None, limit: int = 20
) -> DataFrame:
    """Newest decisions first."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100.")
    for column, value in (("recommendation", recommendation), ("source", source)):
        if value is not None:
            decisions = decisions.filter(F.col(column) == value)
    return decisions.orderBy(F.desc("created_at"), F.desc("decision_id")).limit(limit)


def feedback_list(feedback: DataFrame, incident_id=None, limit: int = 20) -> DataFrame:
    """J2."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100.")
    if incident_id is not None:
        feedback = feedback.filter(F.col("incident_id") == F.lit(incident_id))
    return feedback.orderBy(F.desc("created_at"), F.desc("incident_id")).limit(limit)


def verified_feedback(feedback: DataFrame, organization_id: str, limit: int | None = None) -> DataFrame:
    """Confirmed labels with events, oldest first.

    ``limit`` bounds the labels that a feedback model may be trained on.
    """
    found = feedback.filter(
        (F.col("organization_id") == organization_id)
        & F.col("final_anomaly_label").isin("ANOMALY", "NORMAL")
        & (F.size("incident_events") > 0)
    ).orderBy(F.asc("created_at"), F.asc("incident_id"))
    return found if limit is None else found.limit(limit)


def profile(profiles: DataFrame, organization_id: str) -> DataFrame:
    """J4."""
    return profiles.filter(F.col("organization_id") == organization_id)


def profile_listing(profiles: DataFrame, limit: int = 50) -> DataFrame:
    """Metadata and sizes, never the contents."""
    return profiles.select(
        "organization_id", "display_name", "knowledge_version",
        F.size("services").alias("service_count"),
        F.size("knowledge").alias("knowledge_document_count"),
        F.size("deployments").alias("deployment_count"), "updated_at",
    ).orderBy(F.desc("updated_at"), F.asc("organization_id")).limit(limit)


def learning_examples(feedback: DataFrame) -> DataFrame:
    """(incident_id, text, label, created_at); order by created_at when consuming."""
    messages = F.filter(
        F.transform("incident_events", lambda e: X.strip(F.coalesce(e["message"], F.lit("")))),
        lambda m: m != "")
    label = F.when(F.col("final_anomaly_label") == "ANOMALY", 1).when(
        F.col("final_anomaly_label") == "NORMAL", 0)
    return feedback.select(
        "incident_id", F.array_join(messages, " ").alias("text"), label.alias("label"),
        F.col("created_at").cast("string").alias("created_at"),
    ).filter((F.col("text") != "") & F.col("label").isNotNull())


def decision_counters(decisions: DataFrame) -> DataFrame:
    """Requests by source and recommendation, and how many went to people."""
    return decisions.groupBy("source", "recommendation").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum((F.col("recommendation") == C.NEEDS_REVIEW).cast("int")).alias("human_reviews"))


def failure_counters(quarantine: DataFrame) -> DataFrame:
    """Failures by reason, from rows with a ``failed`` array."""
    return quarantine.select(F.explode("failed").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("failures"))


def latency_histogram(latencies: DataFrame, column: str = "seconds", by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative counts per upper bound."""
    bounds = [(f"{b:g}", F.col(column) <= b) for b in C.LATENCY_BUCKETS] + [("+Inf", F.lit(True))]
    sums = latencies.groupBy(*by).agg(*[
        F.sum(test.cast("int")).alias(f"_{i}") for i, (_, test) in enumerate(bounds)])
    return sums.select(*by, F.inline(F.array(*[
        F.struct(F.lit(name).alias("le"), F.col(f"_{i}").alias("observations"))
        for i, (name, _) in enumerate(bounds)])))
