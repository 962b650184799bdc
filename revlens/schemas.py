"""Table schemas, key columns and value domains."""

from __future__ import annotations

# Schemas are DDL strings, which readers and createDataFrame take as they are.
# Every table is keyed by the code state it describes.
TARGET = ("repository_id", "snapshot_id", "head_sha")

# Allowed words per column.
LABELS = ("human", "ai", "hybrid", "unknown")
LABEL_SOURCES = (
    "declared", "controlled_generation", "verified_agent_account",
    "human_reviewed", "heuristic", "unlabelled",
)
WEAK_LABEL_SOURCES = ("heuristic", "unlabelled")
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERE = ("high", "critical")
STATUSES = ("pass", "warn", "fail", "unknown")
TARGET_KINDS = ("pull_request", "commit", "working_tree")
ATTESTATIONS = ("asserted", "observed", "verified", "demonstration")
WEAK_ATTESTATIONS = ("asserted", "demonstration")
VERIFICATIONS = ("verified", "supported", "speculative", "contradicted", "unverifiable")
SYMBOL_KINDS = ("class", "function", "async_function", "method", "async_method", "nested_function")
TEST_OUTCOMES = ("passed", "failed", "skipped", "xfailed", "xpassed", "error")
FIXTURE_CATEGORIES = (
    "issue_patch_correctness", "ai_assisted_trace", "security_analyzer_oracle",
    "clean_control", "adversarial_integrity",
)
TRUTH_SCOPES = (
    "patch_and_test_outcome", "ai_link_association", "analyzer_expectation",
    "controlled_negative", "integrity_expectation",
)
SCOPES_WITHOUT_AUTHORSHIP = ("ai_link_association", "patch_and_test_outcome", "analyzer_expectation")

# Review dimensions in the order evidence depends on each other.
DIMENSIONS = (
    "evidence_integrity", "evidence_sufficiency", "provenance", "intent_alignment",
    "functional_evidence", "architectural_compatibility", "security_risk",
    "efficiency_risk", "ood_evidence_quality",
)
# Provenance never decides a review action.
ACTION_DIMENSIONS = tuple(item for item in DIMENSIONS if item != "provenance")


_KEYS = "repository_id STRING, snapshot_id STRING, head_sha STRING"
_TARGET_STRUCT = f"target STRUCT<repository_id: STRING, snapshot_id: STRING, head_sha: STRING>"

CODE_SAMPLES = (
    "sample_id STRING, repository_id STRING, group_id STRING, language STRING, code STRING, "
    "path STRING, commit_sha STRING, commit_message STRING, files_changed BIGINT, "
    "additions BIGINT, deletions BIGINT, label STRING, label_source STRING, "
    "generator_family STRING, parent_authorship STRING, metadata MAP<STRING, STRING>"
)
MANIFEST = (
    "sample_id STRING, repository_id STRING, group_id STRING, language STRING, path STRING, "
    "label STRING, label_source STRING, generator_family STRING, code STRING"
)
REPOSITORY_FILES = (f"{_KEYS}, side STRING, path STRING, code STRING")
SYMBOL_STRUCT = (
    "STRUCT<qualified_name: STRING, kind: STRING, start_line: BIGINT, end_line: BIGINT, "
    "potentially_public: BOOLEAN, decorators: ARRAY<STRING>, signature_hash: STRING, body_hash: STRING>"
)
ARTIFACT_STRUCT = (
    "STRUCT<artifact_id: STRING, kind: STRING, producer: STRING, producer_version: STRING, "
    f"{_TARGET_STRUCT.replace('target STRUCT', 'target: STRUCT')}, payload: STRING, content_hash: STRING, "
    "attestation: STRING, execution_id: STRING, complete: BOOLEAN, created_at: STRING, source_uri: STRING>"
)
CLAIM_STRUCT = (
    "STRUCT<claim_id: STRING, category: STRING, severity: STRING, location: STRING, claim: STRING, "
    "producer: STRING, producer_version: STRING, confidence: DOUBLE, verification: STRING, "
    "evidence_refs: ARRAY<STRING>, counter_evidence_refs: ARRAY<STRING>, "
    f"{_TARGET_STRUCT.replace('target STRUCT', 'target: STRUCT')}, created_at: STRING>"
)
LEDGER_DOCUMENT = (
    f"schema_version STRING, {_TARGET_STRUCT}, artifacts ARRAY<{ARTIFACT_STRUCT}>, claims ARRAY<{CLAIM_STRUCT}>"
)
MEASUREMENT_STRUCT = (
    "STRUCT<runtime_ms: DOUBLE, peak_rss_mb: DOUBLE, throughput_per_second: DOUBLE, repeats: BIGINT>"
)
EFFICIENCY_DOCUMENT = (f"baseline {MEASUREMENT_STRUCT}, candidate {MEASUREMENT_STRUCT}")
QUALITY_DOCUMENT = (
    "detector_id STRING, ood_score DOUBLE, context_coverage DOUBLE, schema_supported BOOLEAN"
)
FIXTURE_CATALOG = (
    "dataset_id STRING, record_id STRING, category STRING, ground_truth_scope STRING, "
    "source_url STRING, source_revision STRING, license STRING, payload_hash STRING, "
    "local_path STRING, label_limitations STRING, authorship_label STRING, fetched_at STRING"
)
TEST_REPORT = (
    "schema_version STRING, discovered BIGINT, selected BIGINT, deselected BIGINT, passed BIGINT, "
    "failed BIGINT, runtime_errors BIGINT, skipped BIGINT, xfailed BIGINT, xpassed BIGINT, "
    "collection_errors BIGINT, interrupted BOOLEAN, exit_code BIGINT, complete BOOLEAN, "
    "test_cases ARRAY<STRUCT<node_id: STRING, outcome: STRING>>"
)
FINDINGS = (
    f"{_KEYS}, dimension STRING, status STRING, confidence DOUBLE, severity STRING, summary STRING, "
    "evidence_refs ARRAY<STRING>, tags ARRAY<STRING>"
)
