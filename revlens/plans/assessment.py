"""The whole assessment: evidence tables in, findings and one action per target out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assess, evidence, gates, graph, security
from ..operators.validation import union_all
from ..schemas import TARGET
from ..session import materialise


def working_tree_requests(targets: DataFrame) -> DataFrame:
    """Request columns of a working-tree assessment, which always has partial context."""
    return targets.withColumns({
        "target_id": F.concat(F.lit("working-tree:"), F.col("repository_id")),
        "target_kind": F.lit("working_tree"),
        "tags": F.array(F.lit("REPOSITORY_CONTEXT_PARTIAL")),
    })


def repository_findings(
    targets: DataFrame,
    samples: DataFrame,
    architecture: DataFrame,
    artifacts: DataFrame,
    ledgers: DataFrame,
    runs: DataFrame,
    baseline: DataFrame,
    candidate: DataFrame,
    quality_inputs: DataFrame,
    budget: gates.EfficiencyBudget = gates.EfficiencyBudget(),
    keys: Sequence[str] = TARGET,
) -> DataFrame:
    """All nine findings per target.

    ``targets`` carry ``intent`` and ``tests_passed``. Every input meets its target by
    an equi join after it was reduced to one row per target; the targets themselves feed
    nine findings and are stored once.
    """
    targets = materialise(targets, "targets")
    signals = security.scan_code(samples.select(*keys, "path", "code"))
    return union_all([
        assess.sufficiency_finding(targets, keys),
        assess.integrity_finding(targets, evidence.ledger_integrity(artifacts, ledgers, keys), keys),
        assess.provenance_finding(targets, keys),
        assess.intent_finding(targets, keys),
        assess.functional_finding(targets, runs, keys),
        assess.architecture_finding(targets, architecture, keys),
        assess.security_finding(security.security_rollup(signals, targets, keys), keys),
        assess.efficiency_finding(targets, gates.compare_efficiency(baseline, candidate, budget, keys), keys),
        assess.quality_finding(targets, gates.evidence_quality(quality_inputs), keys),
    ])


def finding_references(
    findings: DataFrame, samples: DataFrame, architecture_signals: DataFrame, artifacts: DataFrame, ledgers: DataFrame,
    keys: Sequence[str] = TARGET,
) -> DataFrame:
    """``keys, dimension, reference``: what every finding rests on, whatever its number.

    Short lists come from the findings, the others from the signals and artifacts of
    assessed targets; ``reference_count`` of a finding counts its rows here.
    """
    short = findings.select(*keys, "dimension", F.explode("evidence_refs").alias("reference"))
    long = union_all([
        security.signal_references(security.scan_code(samples.select(*keys, "path", "code")), keys),
        graph.architecture_references(architecture_signals, keys),
        evidence.artifact_references(artifacts, ledgers, keys),
    ])
    return short.unionByName(long.join(findings.select(*keys).distinct(), list(keys), "left_semi"))


def assess_repositories(findings: DataFrame, targets: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    return assess.assess(findings, working_tree_requests(targets.select(*keys)), keys)
