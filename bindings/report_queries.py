"""Reports and documents of the assessed document sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import evidence, features
from revlens.plans import assessment, report
from revlens.schemas import TARGET
from revlens.session import materialise

from . import evidence_queries
from .evidence_queries import ARTIFACTS_SQL, ORACLES as EVIDENCE_ORACLES, findings_sql
from .inputs import document_samples, table, with_target
from .text_queries import PLACES, S, _lines


def commits(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return with_target(orders, F.concat(F.lit("src"), F.col("o_custkey") % 23)).select(
        *TARGET, F.expr("o_orderkey % 1000").alias("additions"), F.expr("o_orderkey % 7").alias("files_changed"),
    )


def repository_reports(spark, sf_dir):
    inputs = evidence_queries.review_inputs(spark, sf_dir)
    found = materialise(assessment.repository_findings(**inputs), "findings")
    verdicts = assessment.assess_repositories(found, inputs["targets"])
    samples = document_samples(spark, sf_dir)
    values = features.aggregate_feature_values(features.repository_features(samples), "repository")
    reports = report.repository_reports(
        inputs["targets"], samples, commits(spark, sf_dir), verdicts,
        {"repository_features": report.feature_maps(values, "values")},
    )
    return reports.select(
        "repository_id", "files_analyzed", "total_nonblank_lines", F.round("median_file_lines", PLACES).alias("median_file_lines"),
        F.to_json("languages").alias("languages"), "commits_analyzed",
        F.round("median_commit_additions", PLACES).alias("median_commit_additions"),
        F.round("median_commit_files", PLACES).alias("median_commit_files"), "patch_health.action",
        F.col("repository_features.values")["repository_text_lines"].alias("text_lines"),
    )


def assessment_documents(spark, sf_dir):
    inputs = evidence_queries.review_inputs(spark, sf_dir)
    found = materialise(assessment.repository_findings(**inputs), "findings")
    documents = report.assessment_documents(assessment.assess_repositories(found, inputs["targets"]), found)
    field = lambda path: F.get_json_object("document", path)
    return documents.select(
        "repository_id", F.array_join(F.json_object_keys("document"), ",").alias("keys"),
        field("$.action").alias("action"), field("$.findings[0].dimension").alias("first"),
        field("$.findings[8].summary").alias("last_summary"), field("$.findings[6].severity").alias("severity"),
    )


def ledger_documents(spark, sf_dir):
    artifacts, claims = evidence_queries.artifacts(spark, sf_dir), evidence_queries.claims(spark, sf_dir)
    ledgers = evidence_queries.ledger_targets(spark, sf_dir)
    documents = report.ledger_documents(ledgers, artifacts, claims, evidence.ledger_integrity(artifacts, ledgers))
    field = lambda path: F.coalesce(F.get_json_object("record", path), F.lit(""))
    return documents.select(
        "repository_id", "section", F.coalesce("record_id", F.lit("")).alias("record_id"),
        F.when(F.col("section") == "header", field("$.schema_version")).when(F.col("section") == "claims", field("$.severity"))
        .otherwise(field("$.attestation")).alias("detail"),
        F.when(F.col("section") == "header", field("$.target.snapshot_id"))
        .otherwise(F.sha2(F.when(F.col("section") == "claims", field("$.claim")).otherwise(field("$.payload")), 256)).alias("content"),
        field("$.artifacts").alias("artifacts"), field("$.claims").alias("claims"), field("$.integrity.status").alias("status"),
    )


QUERIES = {
    "repository_reports": repository_reports,
    "assessment_documents": assessment_documents,
    "ledger_documents": ledger_documents,
}

ORACLES = {
    "repository_reports": rf"""
WITH s AS (SELECT source AS repository_id, count(*) AS files_analyzed, sum(len([l FOR l IN {_lines('text')} IF regexp_matches(l, '[^{S}]')]))::BIGINT AS total_nonblank_lines,
  round(median(len({_lines('text')})), {PLACES})::DOUBLE AS median_file_lines, sum(len({_lines('text')}))::DOUBLE AS text_lines FROM documents GROUP BY ALL),
l AS (SELECT repository_id, '{{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}}' AS languages
  FROM (SELECT source AS repository_id, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY ALL),
c AS (SELECT 'src' || (o_custkey % 23) AS repository_id, count(*) AS commits_analyzed, round(median(o_orderkey % 1000), {PLACES})::DOUBLE AS median_commit_additions,
  round(median(o_orderkey % 7), {PLACES})::DOUBLE AS median_commit_files FROM orders GROUP BY ALL)
SELECT s.*, languages, commits_analyzed, median_commit_additions, median_commit_files, action
FROM s JOIN l USING (repository_id) JOIN c USING (repository_id) JOIN ({EVIDENCE_ORACLES["review_actions"]}) a USING (repository_id)""",
    "assessment_documents": f"""
SELECT repository_id, 'action,action_reason,confidence,decision_path,findings,missing_evidence,tags,target_id,target_kind' AS keys,
  action, 'evidence_integrity' AS first, q.summary AS last_summary, s.severity
FROM ({EVIDENCE_ORACLES["review_actions"]}) a JOIN (SELECT repository_id, summary FROM ({findings_sql()}) WHERE dimension = 'ood_evidence_quality') q USING (repository_id)
JOIN (SELECT repository_id, severity FROM ({findings_sql()}) WHERE dimension = 'security_risk') s USING (repository_id)""",
    "ledger_documents": f"""
WITH a AS (SELECT source AS repository_id, count(*) AS artifacts FROM documents GROUP BY ALL),
c AS (SELECT 'src' || (conv_id % 20) AS repository_id, count(*) AS claims FROM conversations GROUP BY ALL),
l AS ({EVIDENCE_ORACLES["ledger_integrity"]})
SELECT repository_id, 'header' AS section, '' AS record_id, '2.0' AS detail, 'snap_' || repository_id AS content,
  coalesce(a.artifacts, 0)::VARCHAR AS artifacts, coalesce(claims, 0)::VARCHAR AS claims, status
FROM l LEFT JOIN a USING (repository_id) LEFT JOIN c USING (repository_id)
UNION ALL SELECT repository_id, 'artifacts', artifact_id, attestation, real_hash, '', '', '' FROM ({ARTIFACTS_SQL})
UNION ALL SELECT 'src' || (conv_id % 20), 'claims', conv_id || ':' || turn, CASE WHEN turn % 5 = 4 THEN 'odd' ELSE 'low' END, sha256(text), '', '', ''
FROM conversations WHERE 'src' || (conv_id % 20) IN (SELECT repository_id FROM l)""",
}
