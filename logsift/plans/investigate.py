"""The investigation of a whole table of incidents as one chain of joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from logsift import constants as C
from logsift.operators import investigation as I, metrics as H
from logsift.operators.retrieval import in_scope
from logsift.session import cut_lineage


@dataclass(frozen=True)
class Investigation:
    """One table per result, keyed by incident_id (deployment_context: by service)."""

    summary: DataFrame
    errors: DataFrame
    evidence: DataFrame
    deployments: DataFrame
    deployment_context: DataFrame
    hypotheses: DataFrame
    checks: DataFrame
    decisions: DataFrame


def investigate(
    incidents: DataFrame,
    events: DataFrame,
    knowledge: DataFrame,
    deployments: DataFrame,
    *,
    semantic_weight: float = C.INVESTIGATION_SEMANTIC_WEIGHT,
    minimum_evidence: float = C.MINIMUM_HYPOTHESIS_EVIDENCE,
    scope: Sequence[str] = (),
) -> Investigation:
    """Summaries, evidence, deployments, hypotheses and checks.

    ``incidents``: incident_id, log_text, [scope...], [embedding] and any context columns,
    which ``decisions`` passes through. Infrastructure is never touched: every decision
    asks for an engineer's review. With ``scope`` (organization) all four tables carry its
    columns and nothing crosses them, ids and service names may repeat; rows without an
    organization meet each other only: their knowledge is the bundled corpus.
    """
    incidents, events, knowledge, deployments = (
        in_scope(df, scope) for df in (incidents, events, knowledge, deployments))
    summary = I.incident_summary(events, scope)
    index = I.knowledge_index(knowledge, scope=scope)
    columns = ["incident_id", "log_text", *scope]
    if "embedding" in incidents.columns:
        columns.append("embedding")
    evidence = I.knowledge_evidence(
        incidents.select(*columns), index, semantic_weight=semantic_weight).persist()
    deployed = I.affected_by_deployment(summary, deployments, scope)
    keywords = cut_lineage(I.keyword_table(knowledge, scope))
    hypotheses = I.rank_hypotheses(
        incidents, evidence, keywords, deployed,
        minimum_evidence=minimum_evidence, scope=scope).persist()
    return Investigation(
        summary=summary,
        errors=I.dominant_errors(events, scope=scope),
        evidence=evidence,
        deployments=I.correlate_deployments(summary, deployments, scope),
        deployment_context=I.deployment_context(summary, deployments, scope),
        hypotheses=hypotheses,
        checks=I.plan_checks(evidence, hypotheses, keywords, scope=scope),
        decisions=incidents.drop("log_text").withColumn("decision", F.lit(C.ENGINEER_REVIEW)),
    )


def configuration_trials(
    cases: DataFrame, events: DataFrame, knowledge: DataFrame, deployments: DataFrame,
    weights: Sequence[float] = C.INVESTIGATION_WEIGHTS, thresholds: Sequence[float] = C.INVESTIGATION_EVIDENCE,
) -> DataFrame:
    """H12 input: H11 metrics of all cases under each semantic weight and evidence threshold, as one plan.

    All weights are searched in one product, a threshold is a cell of the evidence score, and
    every case counts in every trial, with or without hypotheses.
    """
    trial = ["semantic_weight", "minimum_evidence"]
    index = I.knowledge_index(knowledge)
    deployed = I.affected_by_deployment(I.incident_summary(events), deployments)
    found = I.knowledge_evidence(
        cases.select("incident_id", "log_text", "embedding"), index, semantic_weight=[float(w) for w in weights])
    # every case's evidence under every weight: kept without the documents' texts and steps
    evidence = cut_lineage(found.select("semantic_weight", "incident_id", "rank", "id", "root_cause", "hybrid_similarity"))
    hypotheses = I.rank_hypotheses(
        cases, evidence, cut_lineage(I.keyword_table(knowledge)), deployed, minimum_evidence=thresholds, by=trial[:1])
    cells = F.array(*[F.struct(F.lit(float(w)).alias(trial[0]), F.lit(float(t)).alias(trial[1])) for w in weights for t in thresholds])
    judged = cases.drop("log_text", "embedding").select("*", F.inline(cells))
    return H.known_unknown_metrics(H.investigator_rows(judged, hypotheses, evidence, trial), trial)
