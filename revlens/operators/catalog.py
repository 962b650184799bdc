"""Catalog of external test fixtures: building, verifying, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import UNIT_SEPARATOR, canonical_json, canonical_text, joined_digest, sha256_hex
from ..functions.paths import escapes_root, slug
from ..functions.text import strip
from .validation import union_all, violations

# Pinned revisions, sources, licences and limits per dataset.
SWEBENCH = {
    "dataset_id": "swebench-lite", "category": "issue_patch_correctness",
    "ground_truth_scope": "patch_and_test_outcome",
    "source_url": "https://huggingface.co/datasets/princeton-nlp/SWE-bench_Lite",
    "source_revision": "6ec7bb89b9342f664a54a6e0a6ea6501d3437cc2",
    "license": "source-repository-specific",
    "label_limitations": (
        "Accepted issue/patch/test outcome; not an authorship, security, or universal quality label."
    ),
}
DEVGPT = {
    "dataset_id": "devgpt", "category": "ai_assisted_trace", "ground_truth_scope": "ai_link_association",
    "source_url": "https://github.com/NAIST-SE/DevGPT",
    "source_revision": "685efd2509dede9a6e996b839ae4e20d33430648", "license": "NOASSERTION",
    "label_limitations": (
        "A shared ChatGPT link is associated with a development artifact; this is not proof "
        "that linked code was generated by AI. Metadata-only research use pending license review."
    ),
}
CODEQL = {
    "dataset_id": "codeql-python-tests", "category": "security_analyzer_oracle",
    "ground_truth_scope": "analyzer_expectation",
    "source_url": "https://github.com/github/codeql/blob/",
    "source_revision": "87c77cc26ccd1d2d9791b8563be6d425ccdf0874", "license": "MIT",
    "label_limitations": "CodeQL query-test fixture for analyzer behavior; not a universal vulnerability label.",
}


def _payload(frame: DataFrame) -> Column:
    return canonical_text(canonical_json(**{name: F.col(name) for name in frame.columns}))


def _rows(frame: DataFrame, fixed: dict, record: Column, digest: Column, local: Column, url: Column | None = None) -> DataFrame:
    constant = {name: F.lit(value) for name, value in fixed.items()}
    if url is not None:
        constant["source_url"] = url
    return frame.select(
        constant["dataset_id"].alias("dataset_id"), record.alias("record_id"),
        constant["category"].alias("category"), constant["ground_truth_scope"].alias("ground_truth_scope"),
        constant["source_url"].alias("source_url"), constant["source_revision"].alias("source_revision"),
        constant["license"].alias("license"), digest.alias("payload_hash"), local.alias("local_path"),
        constant["label_limitations"].alias("label_limitations"),
        F.lit(None).cast("string").alias("authorship_label"), F.lit(None).cast("string").alias("fetched_at"),
    )


def swebench_rows(rows: DataFrame) -> DataFrame:
    record = strip(F.col("instance_id"))
    return _rows(rows, SWEBENCH, record, sha256_hex(_payload(rows)),
                 F.concat(F.lit("swebench/"), slug(record), F.lit(".json")))


def devgpt_rows(rows: DataFrame) -> DataFrame:
    record = joined_digest([strip(F.col("URL")), strip(F.col("MentionedURL"))], UNIT_SEPARATOR, 20)
    return _rows(rows, DEVGPT, record, sha256_hex(_payload(rows)), F.concat(F.lit("devgpt/"), record, F.lit(".json")))


def codeql_rows(files: DataFrame) -> DataFrame:
    record = slug(F.col("path"))
    url = F.concat(F.lit(CODEQL["source_url"] + CODEQL["source_revision"] + "/"), "path")
    return _rows(files, CODEQL, record, sha256_hex(F.col("content")),
                 F.concat(F.lit("codeql/"), record, F.lit(".json")), url)


def payload_violations(catalog: DataFrame, payloads: DataFrame) -> DataFrame:
    """Missing, escaping or altered cached payloads.

    ``payloads``: ``local_path, payload`` (JSON text with keys in any order) and ``content`` (oracle
    text). A payload that is no JSON is altered.
    """
    joined = catalog.join(payloads, "local_path", "left")
    key = ("dataset_id", "record_id")
    is_oracle = F.col("category") == "security_analyzer_oracle"
    observed = F.when(is_oracle, sha256_hex(F.coalesce("content", F.lit("")))).otherwise(
        sha256_hex(F.coalesce(canonical_text(F.col("payload")), F.col("payload"))))
    present = F.col("payload").isNotNull() | F.col("content").isNotNull()
    outside = escapes_root(F.col("local_path"))
    return union_all([
        violations(joined, "fixture_catalog", key, "escapes_root", outside, F.col("local_path")),
        violations(joined, "fixture_catalog", key, "payload_missing", ~outside & ~present, F.col("local_path")),
        violations(joined, "fixture_catalog", key, "hash_mismatch",
                   ~outside & present & (observed != F.col("payload_hash")), F.col("local_path")),
    ])


def catalog_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("dataset_id", "category").agg(
        F.count(F.lit(1)).alias("records"), F.count("authorship_label").alias("authorship_labels")
    )
