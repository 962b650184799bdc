"""Findings per review dimension and the routing of each target to one action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.hashing import PACKED
from ..functions.text import is_blank
from ..schemas import ACTION_DIMENSIONS, DIMENSIONS, SEVERE, TARGET

# Sentences and reasons shown to reviewers.
SUFFICIENCY_SUMMARY = "Working-tree evidence lacks authoritative PR and specification context."
PROVENANCE_SUMMARY = "No verified provenance model or attestation was supplied."
INTENT_PRESENT = "Intent text is available for alignment review."
INTENT_ABSENT = "No issue, specification, or PR intent was supplied."
LEDGER_MISMATCH = "Evidence ledger targets a different code snapshot."
LEDGER_ABSENT = "No commit-bound evidence ledger was supplied."
TEST_MISMATCH = "Observed test artifact does not match the assessed code snapshot."
TEST_INCOMPLETE = "Observed pytest execution was incomplete."
TEST_EMPTY = "Observed pytest execution collected no tests."
TEST_CLAIMED_PASS = "Test success was asserted by the caller without a snapshot-bound artifact."
TEST_CLAIMED_FAIL = "Test failure was asserted by the caller without a snapshot-bound artifact."
TEST_ABSENT = "No test execution evidence was supplied."
EFFICIENCY_WITHIN = "Measured efficiency comparison remained within configured budgets."
EFFICIENCY_WEAK = "Efficiency measurements were missing or statistically insufficient."
QUALITY_ABSENT = "No named OOD and evidence-integrity artifact was supplied."
REASONS = {
    "integrity": "Evidence integrity failure prevents trustworthy automation.",
    "ood": "Out-of-distribution or materially incomplete evidence prevents confident automation.",
    "security": "High-severity security evidence requires specialist review.",
    "architecture": "Architecture evidence indicates an incompatible change.",
    "rewrite": "Failed intent, functional, or efficiency evidence requires correction or validation.",
    "missing": "Required review evidence is missing; request only the unresolved evidence.",
    "allow": (
        "Available intent, functional, architecture, security, and efficiency evidence "
        "supports standard review."
    ),
}
ACTIONS = {
    "integrity": "block_pending_evidence",
    "ood": "block_pending_evidence",
    "security": "require_security_review",
    "architecture": "require_architecture_review",
    "rewrite": "require_human_rewrite_or_validation",
    "missing": "request_targeted_evidence",
    "allow": "allow_standard_review",
}
CORRECTABLE = ("intent_alignment", "functional_evidence", "efficiency_risk")


def no_text() -> Column:
    return F.array().cast("array<string>")


def finding(
    frame: DataFrame,
    keys: Sequence[str],
    dimension: str,
    status: Column,
    confidence: Column,
    severity: Column,
    summary: Column,
    references: Column,
    tags: Column | None = None,
    listed: Column | None = None,
) -> DataFrame:
    """``listed`` counts references that are rows of their own table and not in the array."""
    return frame.select(
        *keys, F.lit(dimension).alias("dimension"), status.alias("status"),
        confidence.cast("double").alias("confidence"), severity.alias("severity"),
        summary.alias("summary"), references.alias("evidence_refs"),
        (no_text() if tags is None else tags).alias("tags"),
        (F.size(references) + F.coalesce(F.lit(0) if listed is None else listed, F.lit(0))).cast("long").alias("reference_count"),
    )


def gate_severity(status: Column, failing: str) -> Column:
    return F.when(status == "fail", failing).when(status == "unknown", "medium").otherwise("info")


def nearest_evidence(targets: DataFrame, evidence: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Evidence of a target's own code state, else of another state of its repository.

    The second case is how a mismatch shows. Both lookups see one row per key, so a
    repository with many states never pairs every target with every record.
    """
    packed = F.struct(
        F.col("snapshot_id").alias("_snapshot"), F.col("head_sha").alias("_head"),
        *[F.col(name).alias(f"_{name}") for name in columns],
    )
    own = evidence.groupBy(*TARGET).agg(F.max_by(packed, order).alias("_own"))
    other = evidence.groupBy("repository_id").agg(
        F.max_by(packed, F.struct("snapshot_id", "head_sha", order)).alias("_other")
    )
    joined = targets.join(own, list(TARGET), "left").join(other, "repository_id", "left")
    return joined.withColumn("_e", F.coalesce("_own", "_other")).select(*targets.columns, "_e.*")


def is_other_state() -> Column:
    return F.coalesce(
        (F.col("_snapshot") != F.col("snapshot_id")) | (F.col("_head") != F.col("head_sha")), F.lit(False)
    )


def sufficiency_finding(targets: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    return finding(
        targets, keys, "evidence_sufficiency", F.lit("warn"), F.lit(0.5), F.lit("medium"),
        F.lit(SUFFICIENCY_SUMMARY), F.array(F.concat(F.lit("repository:"), F.col("repository_id"))),
        F.array(F.lit("REPOSITORY_CONTEXT_PARTIAL")),
    )


def provenance_finding(targets: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    return finding(
        targets, keys, "provenance", F.lit("unknown"), F.lit(0.0), F.lit("info"),
        F.lit(PROVENANCE_SUMMARY), F.array(F.lit("provenance:unavailable")),
        F.array(F.lit("PROVENANCE_UNCERTAIN")),
    )


def intent_finding(targets: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Needs ``intent``; blank text counts as absent."""
    present = ~is_blank(F.coalesce("intent", F.lit("")))
    return finding(
        targets, keys, "intent_alignment",
        F.when(present, "pass").otherwise("unknown"), F.when(present, 0.8).otherwise(0.0),
        F.when(present, "info").otherwise("medium"),
        F.when(present, INTENT_PRESENT).otherwise(INTENT_ABSENT),
        F.array(F.when(present, "intent:user-supplied").otherwise("intent:missing")),
        F.when(present, no_text()).otherwise(F.array(F.lit("INTENT_UNVERIFIED"))),
    )


def functional_finding(targets: DataFrame, runs: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Test evidence per target: a run of another code state fails, then completeness,
    then emptiness, then the result; a caller's word counts little, silence nothing.

    ``targets`` need ``tests_passed``.
    """
    joined = nearest_evidence(targets, runs, (
        "complete", "selected", "exit_code", "failed", "passed", "runtime_errors",
        "duration_seconds", "framework_version", "report_hash",
    ), "report_hash")
    observed = F.col("_complete").isNotNull()
    mismatch = is_other_state()
    incomplete = observed & ~F.col("_complete")
    empty = observed & (F.col("_selected") == 0)
    clean = observed & (F.col("_exit_code") == 0) & (F.col("_failed") == 0) & (F.col("_runtime_errors") == 0)
    claimed = F.col("tests_passed").isNotNull()

    def choose(values: dict[str, object]) -> Column:
        as_column = {name: value if isinstance(value, Column) else F.lit(value) for name, value in values.items()}
        return (
            F.when(mismatch, as_column["mismatch"]).when(incomplete, as_column["incomplete"])
            .when(empty, as_column["empty"]).when(clean, as_column["clean"])
            .when(observed, as_column["failed"]).when(claimed, as_column["claimed"])
            .otherwise(as_column["absent"])
        )

    status = choose({
        "mismatch": "fail", "incomplete": "unknown", "empty": "unknown", "clean": "pass",
        "failed": "fail", "claimed": "warn", "absent": "unknown",
    })
    report = F.col("_report_hash")
    return finding(
        joined, keys, "functional_evidence", status,
        choose({"mismatch": 1.0, "incomplete": 0.0, "empty": 0.0, "clean": 0.9, "failed": 0.9,
                "claimed": 0.35, "absent": 0.0}),
        F.when(status == "pass", "info").when(status == "fail", "high").otherwise("medium"),
        choose({
            "mismatch": TEST_MISMATCH, "incomplete": TEST_INCOMPLETE, "empty": TEST_EMPTY,
            "clean": F.format_string(
                "Observed pytest %s: %d passed, %d failed in %.3fs.",
                "_framework_version", "_passed", "_failed", "_duration_seconds",
            ),
            "failed": F.format_string(
                "Observed pytest failed: %d failed, %d errors, exit %d.",
                "_failed", "_runtime_errors", "_exit_code",
            ),
            "claimed": F.when(F.col("tests_passed"), TEST_CLAIMED_PASS).otherwise(TEST_CLAIMED_FAIL),
            "absent": TEST_ABSENT,
        }),
        F.array(choose({
            "mismatch": F.concat(F.lit("tests:snapshot-mismatch:"), "_snapshot"),
            "incomplete": F.concat(F.lit("tests:"), report, F.lit(":incomplete")),
            "empty": F.concat(F.lit("tests:"), report, F.lit(":empty")),
            "clean": F.concat(F.lit("tests:"), report, F.lit(":observed")),
            "failed": F.concat(F.lit("tests:"), report, F.lit(":failed")),
            "claimed": "tests:caller-asserted", "absent": "tests:missing",
        })),
        F.array(choose({
            "mismatch": "TEST_SNAPSHOT_MISMATCH", "incomplete": "TEST_RUN_INCOMPLETE",
            "empty": "TEST_SUITE_EMPTY", "clean": "TEST_EVIDENCE_OBSERVED",
            "failed": "TEST_EVIDENCE_OBSERVED", "claimed": "TEST_RESULT_UNVERIFIED",
            "absent": "TEST_EVIDENCE_MISSING",
        })),
    )


def integrity_finding(targets: DataFrame, integrity: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Ledger audit per target; ``integrity`` is keyed by the ledger's own code state.

    A ledger of another code state fails but keeps the audit's confidence and tags.
    References of failed artifacts are rows of :func:`evidence.artifact_references`.
    """
    joined = nearest_evidence(
        targets, integrity, ("status", "confidence", "tags", "failed_artifacts"), "artifacts"
    )
    present = F.col("_status").isNotNull()
    mismatch = is_other_state()
    status = F.when(mismatch, "fail").otherwise(F.coalesce("_status", F.lit("unknown")))
    return finding(
        joined, keys, "evidence_integrity", status, F.coalesce("_confidence", F.lit(0.0)),
        gate_severity(status, "critical"),
        F.when(mismatch, LEDGER_MISMATCH)
        .when(present, F.format_string("Ledger integrity audit found %d failed artifact(s).", "_failed_artifacts"))
        .otherwise(LEDGER_ABSENT),
        F.when(mismatch, F.array(F.concat(F.lit("ledger:snapshot-mismatch:"), "_snapshot")))
        .when(present & (F.col("_failed_artifacts") > 0), no_text())
        .when(present, F.array(F.concat(F.lit("ledger:"), "_snapshot", F.lit(":verified"))))
        .otherwise(F.array(F.lit("ledger:missing"))),
        F.coalesce("_tags", F.array(F.lit("EVIDENCE_INTEGRITY_UNKNOWN"))),
        F.when(~mismatch, F.col("_failed_artifacts")),
    )


def architecture_finding(targets: DataFrame, reports: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """``reports``: keys, status, confidence, modules, edges, cycles, signals.

    References of signals are rows of :func:`graph.architecture_references`.
    """
    joined = targets.select(*keys).join(reports, list(keys), "left")
    status = F.coalesce("status", F.lit("pass"))
    modules, edges, cycles = [F.coalesce(name, F.lit(0)) for name in ("modules", "edges", "cycles")]
    return finding(
        joined, keys, "architectural_compatibility", status,
        F.coalesce("confidence", F.lit(1.0)), gate_severity(status, "high"),
        F.format_string(
            "Dependency analysis inspected %d module(s), %d edge(s), and found %d cycle(s).",
            modules, edges, cycles,
        ),
        F.when(F.coalesce("signals", F.lit(0)) > 0, no_text()).otherwise(
            F.array(F.format_string("architecture:%d-modules:%d-edges:no-cycles", modules, edges))
        ),
        listed=F.col("signals"),
    )


def security_finding(rollup: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """References of signals are rows of :func:`security.signal_references`."""
    return finding(
        rollup, keys, "security_risk", F.col("status"), F.lit(0.7), F.col("severity"),
        F.format_string(
            "Static scan found %d production and %d test-only severe signal(s).",
            "production_severe", "test_only_severe",
        ),
        F.when(F.col("signals") > 0, no_text()).otherwise(F.array(F.lit("static-scan:no-findings"))),
        listed=F.col("signals"),
    )


def signed_decimal(value: Column) -> Column:
    """Four places. Exact halves, which are odd multiples of 1/32, go to the even digit; others the formatter rounds."""
    half = F.pmod(value * 32, F.lit(2.0)) == 1
    return F.format_string("%+.4f", F.when(half, F.bround(value, 4)).otherwise(value))


def efficiency_finding(targets: DataFrame, reports: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    joined = targets.select(*keys).join(reports, list(keys), "left")
    compared = F.col("status").isNotNull()
    status = F.coalesce("status", F.lit("unknown"))
    exceeded = F.array_join("exceeded", ", ")
    names = F.array_sort(F.map_keys("deltas"))
    return finding(
        joined, keys, "efficiency_risk", status, F.coalesce("confidence", F.lit(0.0)),
        gate_severity(status, "high"),
        F.when(
            compared & (F.size("exceeded") > 0),
            F.concat(F.lit("Measured efficiency comparison exceeded: "), exceeded, F.lit(".")),
        ).when(status == "pass", EFFICIENCY_WITHIN).otherwise(EFFICIENCY_WEAK),
        F.when(~compared, F.array(F.lit("efficiency:missing")))
        .when(F.size("deltas") == 0, F.array(F.lit("efficiency:no-comparable-metrics")))
        .otherwise(F.transform(
            names,
            lambda name: F.concat(
                F.lit("efficiency:"), name, F.lit(":"), signed_decimal(F.element_at(F.col("deltas"), name))
            ),
        )),
    )


def quality_finding(targets: DataFrame, reports: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    joined = targets.select(*keys).join(reports, list(keys), "left")
    present = F.col("status").isNotNull()
    status = F.coalesce("status", F.lit("unknown"))
    return finding(
        joined, keys, "ood_evidence_quality", status, F.coalesce("confidence", F.lit(0.0)),
        gate_severity(status, "high"),
        F.when(present, F.format_string(
            "Detector %s reported OOD=%.3f with context coverage=%.3f.",
            "detector_id", "ood_score", "context_coverage",
        )).otherwise(QUALITY_ABSENT),
        F.array(
            F.when(present, F.format_string("ood:%s:%.4f", "detector_id", "ood_score")).otherwise("ood:missing")
        ),
        F.coalesce("tags", no_text()),
    )


def assess(findings: DataFrame, targets: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """One action per target with reason, confidence, decision path and missing evidence.

    ``targets`` carry ``tags`` of the request (``target_id`` and ``target_kind`` pass
    through). A target with two findings of one dimension is not routed;
    :func:`validation.repeated_findings` lists it.
    """
    keys = list(keys)
    # One narrow row for each target and dimension, under one digest of the keys; what has another dimension gives only its tags.
    unverified = F.array_contains("tags", "TEST_RESULT_UNVERIFIED")
    ranked = findings.select(
        hashing.key_digest(keys).alias(PACKED), F.coalesce(F.array_position(F.array(*map(F.lit, DIMENSIONS)), F.col("dimension")), F.lit(0)).cast("int").alias("_d"),
        "status", "confidence", "severity", "tags",
    )
    cells = ranked.groupBy(PACKED, "_d").agg(
        F.count(F.lit(1)).alias("n"), F.max("status").alias("status"), F.max("confidence").alias("confidence"),
        F.max("severity").alias("severity"), F.coalesce(F.bool_or(unverified), F.lit(False)).alias("unverified"),
        F.flatten(F.collect_set("tags")).alias("tags"),
    )
    grouped = cells.groupBy(PACKED).agg(F.map_from_entries(F.collect_list(
        F.struct("_d", F.struct("n", "status", "confidence", "severity", "unverified", "tags")))).alias("_cells"))
    cell = lambda name: F.try_element_at("_cells", F.lit(DIMENSIONS.index(name) + 1))
    passed = [name for name in targets.columns if name not in (*keys, "tags")]
    joined = targets.select(*keys, *passed, F.col("tags").alias("_request"), hashing.key_digest(keys).alias(PACKED)).join(grouped, PACKED, "left")
    repeated = F.exists(F.map_entries("_cells"), lambda entry: (entry["key"] > 0) & (entry["value"]["n"] > 1))
    frame = joined.filter(~F.coalesce(repeated, F.lit(False))).select(
        *keys, *passed, "_request",
        *[cell(name)["status"].alias(f"_s_{name}") for name in DIMENSIONS],
        *[cell(name)["confidence"].alias(f"_c_{name}") for name in DIMENSIONS],
        cell("security_risk")["severity"].alias("_security"),
        F.coalesce(cell("functional_evidence")["unverified"], F.lit(False)).alias("_unverified"),
        F.flatten(F.transform(F.map_values("_cells"), lambda value: value["tags"])).alias("_tags"),
    )

    def status(name: str) -> Column:
        return F.col(f"_s_{name}")

    def absent(name: str) -> Column:
        gone = status(name).isNull() | (status(name) == "unknown")
        return gone | F.coalesce("_unverified", F.lit(False)) if name == "functional_evidence" else gone

    def names_where(names: Sequence[str], condition) -> Column:
        return F.array_compact(F.array(*[F.when(condition(name), F.lit(name)) for name in names]))

    frame = frame.withColumn("missing_evidence", names_where(ACTION_DIMENSIONS, absent))
    test_gap = F.when(absent("functional_evidence"), F.array(F.lit("TEST_EVIDENCE_MISSING"))).otherwise(no_text())
    frame = frame.withColumn(
        "tags",
        F.array_sort(F.array_distinct(F.concat(
            F.coalesce("_request", no_text()), F.coalesce("_tags", no_text()), test_gap
        ))),
    )

    def failing(name: str) -> Column:
        return F.coalesce(status(name) == "fail", F.lit(False))

    strange = F.array_contains("tags", "OOD_INPUT")
    rewrite = failing(CORRECTABLE[0]) | failing(CORRECTABLE[1]) | failing(CORRECTABLE[2])
    route = (
        F.when(failing("evidence_integrity"), "integrity")
        .when(strange | failing("ood_evidence_quality"), "ood")
        .when(failing("security_risk") & F.col("_security").isin(*SEVERE), "security")
        .when(failing("architectural_compatibility"), "architecture")
        .when(rewrite, "rewrite")
        .when(F.size("missing_evidence") > 0, "missing")
        .otherwise("allow")
    )
    frame = frame.withColumn("_route", route)
    chosen = F.col("_route")

    def by_route(values: dict[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), chosen)

    sufficiency = F.array(F.lit("evidence_sufficiency"))
    path = (
        F.when(chosen == "integrity", F.array(F.lit("evidence_integrity"), F.lit("evidence_sufficiency")))
        .when(chosen == "ood", F.concat(sufficiency, F.array(F.lit("ood_evidence_quality"))))
        .when(chosen == "security", F.concat(sufficiency, F.array(F.lit("security_risk"))))
        .when(chosen == "architecture", F.concat(sufficiency, F.array(F.lit("architectural_compatibility"))))
        .when(chosen == "rewrite", F.concat(sufficiency, names_where(CORRECTABLE, failing)))
        .when(chosen == "missing", F.concat(sufficiency, F.col("missing_evidence")))
        .otherwise(names_where(ACTION_DIMENSIONS, lambda name: status(name).isNotNull()))
    )
    lowest = F.coalesce(F.least(*[F.col(f"_c_{name}") for name in ACTION_DIMENSIONS]), F.lit(0.0))
    confidence = F.when(F.size("missing_evidence") > 0, 0.0).otherwise(lowest)
    capped = F.when(
        strange | F.array_contains("tags", "REPOSITORY_CONTEXT_PARTIAL"), F.least(confidence, F.lit(0.25))
    ).otherwise(confidence)
    return frame.select(
        *keys, *passed,
        by_route(ACTIONS).alias("action"), by_route(REASONS).alias("action_reason"),
        capped.alias("confidence"), path.alias("decision_path"), "missing_evidence", "tags",
    )
