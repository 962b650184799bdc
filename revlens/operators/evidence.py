"""Evidence ledger: recomputed hashes, integrity per code state, test artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, sha256_hex
from ..functions.text import each
from ..schemas import TARGET, TEST_OUTCOMES, TEST_REPORT, WEAK_ATTESTATIONS


def hash_matches() -> Column:
    return sha256_hex(F.col("payload")) == F.col("content_hash")


def failed_artifacts(artifacts: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Artifacts whose payload does not give the recorded digest."""
    return artifacts.filter(~hash_matches()).select(*keys, "artifact_id")


def artifact_references(artifacts: DataFrame, ledgers: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """``artifact:<id>`` per failed artifact of a ledger, kept as rows because their number has no bound."""
    failed = failed_artifacts(artifacts, keys).join(ledgers.select(*keys), list(keys), "left_semi")
    return failed.select(
        *keys, F.lit("evidence_integrity").alias("dimension"), F.concat(F.lit("artifact:"), "artifact_id").alias("reference")
    )


def ledger_integrity(artifacts: DataFrame, ledgers: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Status, confidence and tags per ledger; failed ids stay in their own table.

    Only three counters per target are shuffled, whatever the number of artifacts.
    """
    keys = list(keys)
    weak = ~F.coalesce(F.col("complete"), F.lit(False)) | F.col("attestation").isin(*WEAK_ATTESTATIONS)
    counts = artifacts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("artifacts"),
        F.count_if(~hash_matches()).alias("failed_artifacts"),
        F.count_if(weak).alias("weak_artifacts"),
    )
    joined = ledgers.select(*keys).join(counts, keys, "left").fillna(0)
    empty, failed, weakened = (
        F.col("artifacts") == 0, F.col("failed_artifacts") > 0, F.col("weak_artifacts") > 0
    )
    tag = (
        F.when(empty, "EVIDENCE_INTEGRITY_UNKNOWN").when(failed, "EVIDENCE_INTEGRITY_FAILED")
        .when(weakened, "EVIDENCE_ATTESTATION_INSUFFICIENT")
    )
    return joined.select(
        *keys, "artifacts", "failed_artifacts", "weak_artifacts",
        F.when(empty, "unknown").when(failed, "fail").when(weakened, "unknown").otherwise("pass").alias("status"),
        F.when(empty, 0.0).when(failed, 1.0).when(weakened, 0.0).otherwise(0.9).alias("confidence"),
        F.array_compact(F.array(tag)).alias("tags"),
    )


def missing_references(claims: DataFrame, artifacts: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Claim references, for and against, that name no artifact of the same code state."""
    keys = list(keys)
    none = F.array().cast("array<string>")
    references = claims.select(
        *keys, "claim_id",
        F.explode(
            F.array_union(
                F.coalesce("evidence_refs", none), F.coalesce("counter_evidence_refs", none)
            )
        ).alias("artifact_id"),
    )
    return references.join(artifacts.select(*keys, "artifact_id"), [*keys, "artifact_id"], "left_anti")


def outcome_counts(cases: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """One row per run with a count column for every outcome."""
    return cases.groupBy(*keys).agg(
        *[F.count_if(F.col("outcome") == outcome).alias(outcome) for outcome in TEST_OUTCOMES]
    )


_COUNTERS = (
    "discovered", "selected", "deselected", "passed", "failed", "runtime_errors", "skipped",
    "xfailed", "xpassed", "collection_errors",
)


def _report_fields() -> dict[str, Column]:
    fields = {name: F.col(name) for name in _COUNTERS}
    fields |= {
        name: F.col(name)
        for name in ("interrupted", "timed_out", "exit_code", "complete", "repository_changed", "test_cases")
    }
    fields["schema_version"] = F.lit("1.0")
    return fields


def test_runs(executions: DataFrame) -> DataFrame:
    """Runs from raw executions: target keys, ``report`` JSON, ``output``, ``exit_code``,
    ``timed_out``, ``duration_seconds``, ``framework``, ``framework_version`` and
    ``after_snapshot_id``. A time-out or a changed repository makes a run incomplete.
    """
    parsed = executions.withColumn("_r", F.from_json(F.coalesce("report", F.lit("{}")), TEST_REPORT))
    cases = F.filter(
        F.coalesce("_r.test_cases", F.from_json(F.lit("[]"), "array<struct<node_id: string, outcome: string>>")),
        lambda case: case["node_id"].isNotNull() & case["outcome"].isNotNull(),
    )
    changed = F.col("after_snapshot_id") != F.col("snapshot_id")
    timed_out = F.col("timed_out")
    runs = parsed.select(
        *TARGET,
        *[F.coalesce(F.col(f"_r.{name}"), F.lit(0)).alias(name) for name in _COUNTERS],
        (F.coalesce("_r.interrupted", F.lit(False)) | timed_out).alias("interrupted"),
        "timed_out",
        F.when(timed_out, F.lit(124)).otherwise(F.col("exit_code")).cast("long").alias("exit_code"),
        (F.coalesce("_r.complete", F.lit(False)) & ~timed_out & ~changed).alias("complete"),
        changed.alias("repository_changed"),
        "duration_seconds", "framework", "framework_version",
        sha256_hex(F.col("output")).alias("output_hash"),
        F.lit("observed").alias("attestation"),
        cases.alias("test_cases"),
    )
    return runs.withColumn("report_hash", sha256_hex(canonical_json(**_report_fields())))


def test_cases(runs: DataFrame) -> DataFrame:
    return runs.select(*TARGET, each(F.col("test_cases")).alias("_c")).select(*TARGET, "_c.*")


def test_artifacts(runs: DataFrame, created_at: str) -> DataFrame:
    """Each run as a ledger artifact with a recomputed content hash and the time the caller names."""
    return runs.withColumn("payload", canonical_json(**_report_fields())).select(
        *TARGET,
        F.concat(F.lit("pytest:"), F.substring("report_hash", 1, 16)).alias("artifact_id"),
        F.lit("test_report").alias("kind"),
        F.col("framework").alias("producer"),
        F.col("framework_version").alias("producer_version"),
        "payload",
        sha256_hex(F.col("payload")).alias("content_hash"),
        "attestation",
        F.concat(F.lit("local:"), "report_hash").alias("execution_id"),
        "complete",
        F.lit(created_at).alias("created_at"),
        F.lit("").alias("source_uri"),
    )
