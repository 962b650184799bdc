"""Ledger, gates, findings and routing over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import assess, evidence, gates, validation
from revlens.plans import assessment
from revlens.schemas import SEVERITIES, TARGET
from revlens.session import materialise

from .inputs import DOCUMENT_SAMPLES_SQL, document_samples, table, with_target
from .text_queries import PLACES, signals_sql


def artifacts(spark, sf_dir):
    """Documents as artifacts; every 97th recorded digest is altered."""
    documents = with_target(table(spark, sf_dir, "documents"), F.col("source"))
    digest = F.sha2("text", 256)
    return documents.select(
        *TARGET,
        F.col("doc_id").cast("string").alias("artifact_id"),
        F.lit("document").alias("kind"), F.lit("driver").alias("producer"),
        F.lit("1").alias("producer_version"), F.col("text").alias("payload"),
        F.when(F.col("doc_id") % 97 == 0, F.reverse(digest)).otherwise(digest).alias("content_hash"),
        F.element_at(F.array(*map(F.lit, ("observed", "verified", "asserted", "demonstration"))),
                     F.when(F.col("source").isin("src3", "src4"), (F.col("doc_id") % 2 + 1))
                     .otherwise(F.col("doc_id") % 4 + 1).cast("int")).alias("attestation"),
        F.concat(F.lit("run"), "doc_id").alias("execution_id"),
        (F.col("n_chars") > 150).alias("complete"),
        F.lit("2024-01-01T00:00:00+00:00").alias("created_at"), F.lit("").alias("source_uri"),
    )


def ledger_targets(spark, sf_dir):
    """Every document source, and every language as a ledger without artifacts."""
    documents = table(spark, sf_dir, "documents")
    names = documents.select(F.col("source").alias("name")).union(documents.select("lang")).distinct()
    return with_target(names, F.col("name")).select(*TARGET)


def claims(spark, sf_dir):
    talk = with_target(table(spark, sf_dir, "conversations"), F.concat(F.lit("src"), F.col("conv_id") % 20))
    return talk.select(
        *TARGET, F.concat_ws(":", "conv_id", "turn").alias("claim_id"), F.col("role").alias("category"),
        F.when(F.col("turn") % 5 == 4, "odd").otherwise("low").alias("severity"),
        F.lit("").alias("location"), F.col("text").alias("claim"),
        F.when(F.col("turn") == 3, F.lit(" ")).otherwise(F.lit("tool")).alias("producer"),
        F.lit("1").alias("producer_version"),
        (F.col("turn") / 4.0).alias("confidence"), F.lit("supported").alias("verification"),
        F.when(F.col("turn") > 5, F.array().cast("array<string>"))
        .otherwise(F.array((F.col("conv_id") * 50).cast("string"))).alias("evidence_refs"),
        F.array((F.col("conv_id") * 20 + F.col("conv_id") % 20).cast("string")).alias("counter_evidence_refs"),
        F.when(F.col("turn") % 7 == 6, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("created_at"),
    )


def ledger_integrity(spark, sf_dir):
    report = evidence.ledger_integrity(artifacts(spark, sf_dir), ledger_targets(spark, sf_dir))
    return report.withColumn("tags", F.array_join("tags", ","))


def failed_artifacts(spark, sf_dir):
    return evidence.failed_artifacts(artifacts(spark, sf_dir))


def claim_missing_references(spark, sf_dir):
    found = evidence.missing_references(claims(spark, sf_dir), artifacts(spark, sf_dir))
    return found.select("repository_id", "claim_id", "artifact_id")


def claim_violations(spark, sf_dir):
    rows, key = claims(spark, sf_dir), ("claim_id",)
    known = artifacts(spark, sf_dir).filter(F.col("artifact_id") != "").select(*TARGET).filter(
        F.col("repository_id") != "src7"
    )
    return validation.union_all([
        validation.duplicates(rows, "claims", key),
        validation.not_in_domain(rows, "claims", key, "severity", SEVERITIES),
        validation.blank_text(rows, "claims", key, "producer"),
        validation.outside_unit_interval(rows, "claims", key, "confidence"),
        validation.naive_timestamp(rows, "claims", key),
        validation.claims_without_reference(rows),
        validation.foreign_target(rows, known, "claims", key),
    ])


def artifact_violations(spark, sf_dir):
    """Line items as artifacts: repeated ids, broken digests, bad measures."""
    lineitem = table(spark, sf_dir, "lineitem")
    key = ("l_orderkey", "l_linenumber")
    hashed = lineitem.withColumn(
        "digest", F.when(F.col("l_returnflag") == "R", F.upper(F.sha2(F.col("l_partkey").cast("string"), 256)))
        .otherwise(F.sha2(F.col("l_partkey").cast("string"), 256))
    )
    return validation.union_all([
        validation.duplicates(lineitem, "lineitem", key),
        validation.malformed_digest(hashed, "lineitem", key, "digest"),
        validation.below_minimum(lineitem, "lineitem", key, "l_tax", 0.0, strict=True),
        validation.below_minimum(lineitem, "lineitem", key, "l_linenumber", 2),
    ])


def measurements(spark, sf_dir, candidate: bool):
    lineitem = table(spark, sf_dir, "lineitem")
    late = F.col("l_shipdate") >= "1998-01-01"
    side = with_target(lineitem.filter(late if candidate else ~late), F.col("l_suppkey"))
    return side.groupBy(*TARGET).agg(
        F.round(F.avg("l_extendedprice"), 4).alias("runtime_ms"),
        F.when(F.count(F.lit(1)) % 5 != 0, F.max("l_quantity")).alias("peak_rss_mb"),
        F.round(F.avg("l_quantity"), 4).alias("throughput_per_second"),
        F.count(F.lit(1)).alias("repeats"),
    )


def efficiency(spark, sf_dir):
    budget = gates.EfficiencyBudget(0.02, 0.0, 0.02, 100)
    report = gates.compare_efficiency(
        measurements(spark, sf_dir, False), measurements(spark, sf_dir, True), budget
    )
    return report.select(
        "repository_id", "status", F.round("confidence", PLACES).alias("confidence"),
        F.array_join("exceeded", ",").alias("exceeded"),
        *[F.round(F.try_element_at("deltas", F.lit(name)), PLACES).alias(name) for name in gates.METRICS],
        "baseline_repeats", "candidate_repeats",
    )


def quality_inputs(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return with_target(customer, F.col("c_custkey")).select(
        *TARGET, F.col("c_name").alias("detector_id"),
        (F.pmod(F.col("c_custkey") * 37, F.lit(100)) / 100.0).alias("ood_score"),
        (F.pmod(F.col("c_custkey") * 53, F.lit(100)) / 100.0).alias("context_coverage"),
        (F.col("c_acctbal") > 0).alias("schema_supported"),
    )


def evidence_quality(spark, sf_dir):
    report = gates.evidence_quality(quality_inputs(spark, sf_dir))
    return report.select(
        "detector_id", "status", F.round("confidence", PLACES).alias("confidence"),
        F.array_join("tags", ",").alias("tags"),
    )


def executions(spark, sf_dir):
    """One test report per eight consecutive events, written as JSON and parsed back."""
    events = table(spark, sf_dir, "events")
    outcome = (
        F.when(F.col("event_type") == "click", "passed").when(F.col("event_type") == "view", "passed")
        .when(F.col("event_type") == "purchase", "skipped").when(F.col("event_type") == "signup", "xfailed")
        .otherwise("failed")
    )
    cases = events.select(
        F.expr("event_id div 8").alias("run_id"),
        F.concat(F.lit("tests/t.py::test_"), "user_id", F.lit("["), F.col("event_id"), F.lit("]")).alias("node_id"),
        outcome.alias("outcome"),
    )
    reports = cases.groupBy("run_id").agg(
        F.to_json(F.struct(
            F.count(F.lit(1)).alias("discovered"), F.count(F.lit(1)).alias("selected"),
            F.count_if(F.col("outcome") == "passed").alias("passed"),
            F.count_if(F.col("outcome") == "failed").alias("failed"),
            F.lit(True).alias("complete"),
            F.array_sort(F.collect_list(F.struct("node_id", "outcome"))).alias("test_cases"),
        )).alias("report"),
        F.count_if(F.col("outcome") == "failed").alias("failures"),
    )
    return with_target(reports, F.col("run_id")).select(
        *TARGET, "report", F.lit("").alias("output"),
        F.when(F.col("failures") > 0, 1).otherwise(0).cast("long").alias("exit_code"),
        (F.col("run_id") % 11 == 3).alias("timed_out"), F.lit(1.5).alias("duration_seconds"),
        F.lit("pytest").alias("framework"), F.lit("8").alias("framework_version"),
        F.when(F.col("run_id") % 13 == 5, "moved").otherwise(F.col("snapshot_id")).alias("after_snapshot_id"),
    )


def test_runs(spark, sf_dir):
    runs = evidence.test_runs(executions(spark, sf_dir))
    return runs.select(
        "repository_id", "discovered", "selected", "passed", "failed", "skipped", "exit_code", "timed_out",
        "interrupted", "complete", "repository_changed", F.size("test_cases").cast("long").alias("cases"),
    )


def outcome_counts(spark, sf_dir):
    return evidence.outcome_counts(evidence.test_cases(evidence.test_runs(executions(spark, sf_dir))), ["repository_id"])


def test_artifacts(spark, sf_dir):
    rows = evidence.test_artifacts(evidence.test_runs(executions(spark, sf_dir)), "2024-01-01T00:00:00+00:00")
    return rows.select("repository_id", "kind", "complete", "content_hash", "created_at", F.length("payload").cast("long").alias("size"))


def review_inputs(spark, sf_dir):
    """Every document source assessed with all evidence the other tables can give."""
    samples = document_samples(spark, sf_dir)
    targets = samples.select(*TARGET).distinct().select(
        *TARGET,
        F.when(F.col("repository_id").endswith("1"), F.lit(" ")).otherwise(F.lit("import corpus")).alias("intent"),
        F.when(F.col("repository_id").endswith("2"), F.lit(True)).alias("tests_passed"),
    )
    rename = lambda frame: with_target(
        frame.drop("snapshot_id", "head_sha"), F.concat(F.lit("src"), F.col("repository_id"))
    )
    runs = rename(evidence.test_runs(executions(spark, sf_dir))).filter(~F.col("repository_id").endswith("2"))
    moved = F.col("repository_id") == "src8"
    runs = runs.withColumn("head_sha", F.when(moved, "elsewhere").otherwise(F.col("head_sha")))
    languages = samples.groupBy(*TARGET).agg(
        F.count_distinct("language").alias("modules"), F.count(F.lit(1)).alias("edges"),
        F.count_if(F.col("additions") > 15000).alias("cycles"),
    )
    architecture = languages.select(
        *TARGET, "modules", "edges", "cycles", F.col("cycles").alias("signals"),
        F.when(F.col("cycles") > 0, "fail").otherwise("pass").alias("status"), F.lit(1.0).alias("confidence"),
    )
    quality = rename(quality_inputs(spark, sf_dir))
    return dict(
        targets=targets, samples=samples, architecture=architecture,
        artifacts=artifacts(spark, sf_dir), ledgers=ledger_targets(spark, sf_dir), runs=runs,
        baseline=rename(measurements(spark, sf_dir, False)),
        candidate=rename(measurements(spark, sf_dir, True)), quality_inputs=quality,
    )


def review_findings(spark, sf_dir):
    found = assessment.repository_findings(**review_inputs(spark, sf_dir))
    return found.select(
        "repository_id", "dimension", "status", F.round("confidence", PLACES).alias("confidence"),
        "severity", F.array_join("tags", ",").alias("tags"), F.array_join("evidence_refs", "|").alias("refs"), "summary",
        "reference_count",
    )


def finding_references(spark, sf_dir):
    inputs = review_inputs(spark, sf_dir)
    found = materialise(assessment.repository_findings(**inputs), "findings")
    samples = inputs["samples"]
    cycles = samples.filter(F.col("additions") > 15000).select(*TARGET, "path", F.lit("ARCH-CYCLE").alias("rule_id"))
    return assessment.finding_references(found, samples, cycles, inputs["artifacts"], inputs["ledgers"]).select(
        "repository_id", "dimension", "reference"
    )


def flat_assessment(frame):
    return frame.select(
        "repository_id", "target_id", "target_kind", "action", "action_reason",
        F.round("confidence", PLACES).alias("confidence"),
        F.array_join("decision_path", ",").alias("decision_path"),
        F.array_join("missing_evidence", ",").alias("missing_evidence"), F.array_join("tags", ",").alias("tags"),
    )


def review_actions(spark, sf_dir):
    inputs = review_inputs(spark, sf_dir)
    found = assessment.repository_findings(**inputs)
    return flat_assessment(assessment.assess_repositories(found, inputs["targets"]))


def line_dimension():
    names = (
        "evidence_integrity", "evidence_sufficiency", "intent_alignment", "functional_evidence",
        "architectural_compatibility", "security_risk", "efficiency_risk", "ood_evidence_quality", "provenance",
    )
    return F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 9 + 1).cast("int")).alias("dimension")


def finding_violations(spark, sf_dir):
    """One finding per line item, so that orders repeat dimensions."""
    lineitem = table(spark, sf_dir, "lineitem")
    return validation.repeated_findings(with_target(lineitem, F.col("l_orderkey")).select(*TARGET, line_dimension()))


def routed_orders(spark, sf_dir):
    """Routing alone, over one request per order whose findings come from its line items."""
    lineitem = table(spark, sf_dir, "lineitem")
    one = lineitem.groupBy("l_orderkey", line_dimension()).agg(
        F.min("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.min("l_returnflag").alias("f"),
    )
    found = with_target(one, F.col("l_orderkey")).select(
        *TARGET, "dimension",
        F.when(F.col("q") <= 3, "fail").when(F.col("q") <= 6, "unknown").when(F.col("q") <= 20, "warn")
        .otherwise("pass").alias("status"),
        (1 - F.col("d")).alias("confidence"),
        F.when(F.col("f") == "R", "critical").when(F.col("f") == "A", "high").otherwise("low").alias("severity"),
        F.lit("").alias("summary"), assess.no_text().alias("evidence_refs"),
        F.when((F.col("dimension") == "functional_evidence") & (F.col("f") == "N"),
               F.array(F.lit("TEST_RESULT_UNVERIFIED")))
        .when((F.col("dimension") == "ood_evidence_quality") & (F.col("q") > 48), F.array(F.lit("OOD_INPUT")))
        .otherwise(assess.no_text()).alias("tags"),
    )
    orders = with_target(table(spark, sf_dir, "orders"), F.col("o_orderkey")).select(
        *TARGET, F.concat(F.lit("order:"), "o_orderkey").alias("target_id"),
        F.when(F.col("o_orderstatus") == "F", "commit").otherwise("pull_request").alias("target_kind"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("URGENT"))).otherwise(assess.no_text()).alias("tags"),
    )
    return flat_assessment(assess.assess(found, orders)).drop("action_reason")


QUERIES = {
    "ledger_integrity": ledger_integrity,
    "failed_artifacts": failed_artifacts,
    "claim_missing_references": claim_missing_references,
    "claim_violations": claim_violations,
    "artifact_violations": artifact_violations,
    "efficiency": efficiency,
    "evidence_quality": evidence_quality,
    "test_runs": test_runs,
    "outcome_counts": outcome_counts,
    "test_artifacts": test_artifacts,
    "review_findings": review_findings,
    "finding_references": finding_references,
    "finding_violations": finding_violations,
    "review_actions": review_actions,
    "routed_orders": routed_orders,
}

ARTIFACTS_SQL = """
SELECT source AS repository_id, doc_id::VARCHAR AS artifact_id, sha256(text) AS real_hash,
  CASE WHEN doc_id % 97 = 0 THEN reverse(sha256(text)) ELSE sha256(text) END AS content_hash,
  CASE WHEN source IN ('src3', 'src4') THEN ['observed', 'verified'][doc_id % 2 + 1]
       ELSE ['observed', 'verified', 'asserted', 'demonstration'][doc_id % 4 + 1] END AS attestation,
  n_chars > 150 AS complete FROM documents"""

LEDGER_SQL = f"""
WITH a AS (SELECT repository_id, count(*) AS artifacts,
    count(*) FILTER (real_hash <> content_hash) AS failed_artifacts,
    count(*) FILTER (NOT complete OR attestation IN ('asserted', 'demonstration')) AS weak_artifacts
  FROM ({ARTIFACTS_SQL}) GROUP BY ALL)
SELECT repository_id, 'snap_' || repository_id AS snapshot_id, sha256(repository_id) AS head_sha,
  coalesce(artifacts, 0) AS artifacts, coalesce(failed_artifacts, 0) AS failed_artifacts,
  coalesce(weak_artifacts, 0) AS weak_artifacts,
  CASE WHEN artifacts IS NULL THEN 'unknown' WHEN failed_artifacts > 0 THEN 'fail'
       WHEN weak_artifacts > 0 THEN 'unknown' ELSE 'pass' END AS status,
  (CASE WHEN artifacts IS NULL THEN 0 WHEN failed_artifacts > 0 THEN 1 WHEN weak_artifacts > 0 THEN 0 ELSE 0.9 END)::DOUBLE AS confidence,
  CASE WHEN artifacts IS NULL THEN 'EVIDENCE_INTEGRITY_UNKNOWN' WHEN failed_artifacts > 0 THEN 'EVIDENCE_INTEGRITY_FAILED'
       WHEN weak_artifacts > 0 THEN 'EVIDENCE_ATTESTATION_INSUFFICIENT' ELSE '' END AS tags
FROM (SELECT source AS repository_id FROM documents UNION SELECT lang FROM documents) LEFT JOIN a USING (repository_id)"""

CLAIMS_SQL = """
SELECT 'src' || (conv_id % 20) AS repository_id, conv_id || ':' || turn AS claim_id,
  CASE WHEN turn % 5 = 4 THEN 'odd' ELSE 'low' END AS severity,
  CASE WHEN turn = 3 THEN ' ' ELSE 'tool' END AS producer, turn / 4.0::DOUBLE AS confidence,
  CASE WHEN turn > 5 THEN [] ELSE [(conv_id * 50)::VARCHAR] END AS evidence_refs,
  [(conv_id * 20 + conv_id % 20)::VARCHAR] AS counter_evidence_refs,
  CASE WHEN turn % 7 = 6 THEN '2024-01-01T00:00:00' ELSE '2024-01-01T00:00:00Z' END AS created_at
FROM conversations"""


def measurements_sql(condition: str) -> str:
    return f"""SELECT l_suppkey::VARCHAR AS repository_id, round(avg(l_extendedprice), 4) AS runtime_ms,
  CASE WHEN count(*) % 5 <> 0 THEN max(l_quantity) END AS peak_rss_mb,
  round(avg(l_quantity), 4) AS throughput_per_second, count(*) AS repeats
FROM lineitem WHERE {condition} GROUP BY ALL"""


def efficiency_sql(runtime: float, memory: float, throughput: float, repeats: int, more: str = "") -> str:
    return f"""
WITH b AS ({measurements_sql("l_shipdate < TIMESTAMP '1998-01-01'")}),
c AS ({measurements_sql("l_shipdate >= TIMESTAMP '1998-01-01'")}),
d AS (SELECT repository_id, (c.runtime_ms - b.runtime_ms) / b.runtime_ms AS runtime_ms,
  (c.peak_rss_mb - b.peak_rss_mb) / b.peak_rss_mb AS peak_rss_mb,
  (c.throughput_per_second - b.throughput_per_second) / b.throughput_per_second AS throughput_per_second,
  b.repeats AS baseline_repeats, c.repeats AS candidate_repeats FROM b JOIN c USING (repository_id)),
e AS (SELECT *, list_filter([CASE WHEN peak_rss_mb > {memory} THEN 'peak_rss_mb' END,
    CASE WHEN runtime_ms > {runtime} THEN 'runtime_ms' END,
    CASE WHEN throughput_per_second < -{throughput} THEN 'throughput_per_second' END], lambda x: x IS NOT NULL) AS over FROM d)
SELECT repository_id, CASE WHEN least(baseline_repeats, candidate_repeats) < {repeats} THEN 'unknown'
    WHEN len(over) > 0 THEN 'fail' ELSE 'pass' END AS status,
  round(least(1.0, least(baseline_repeats, candidate_repeats) / {float(max(repeats, 5))}), {PLACES})::DOUBLE AS confidence,
  array_to_string(over, ',') AS exceeded, round(runtime_ms, {PLACES}) AS runtime_ms,
  round(peak_rss_mb, {PLACES}) AS peak_rss_mb, round(throughput_per_second, {PLACES}) AS throughput_per_second,
  baseline_repeats, candidate_repeats{more} FROM e"""


# References show changes with four places, taken from the changes themselves and not from their rounded values.
REFERENCES_SQL = """, concat_ws('|', 'efficiency:peak_rss_mb:' || printf('%+.4f', peak_rss_mb), 'efficiency:runtime_ms:' || printf('%+.4f', runtime_ms),
  'efficiency:throughput_per_second:' || printf('%+.4f', throughput_per_second)) AS refs"""


QUALITY_SQL = f"""
SELECT c_custkey, c_name AS detector_id, o AS ood_score, v AS context_coverage,
  CASE WHEN NOT s OR v < 0.8 THEN 'unknown' WHEN o >= 0.7 THEN 'fail' ELSE 'pass' END AS status,
  (CASE WHEN NOT s OR v < 0.8 THEN 0 ELSE round(1 - o, {PLACES}) END)::DOUBLE AS confidence,
  array_to_string(list_filter([CASE WHEN o >= 0.7 THEN 'OOD_INPUT' END,
    CASE WHEN v < 0.8 THEN 'REPOSITORY_CONTEXT_PARTIAL' END,
    CASE WHEN NOT s THEN 'SCHEMA_UNSUPPORTED' END], lambda x: x IS NOT NULL), ',') AS tags
FROM (SELECT *, (c_custkey * 37 % 100)::DOUBLE / 100 AS o, (c_custkey * 53 % 100)::DOUBLE / 100 AS v, c_acctbal > 0 AS s FROM customer)"""

RUNS_SQL = """
SELECT event_id // 8 AS run_id, (event_id // 8)::VARCHAR AS repository_id, count(*) AS discovered, count(*) AS selected,
  count(*) FILTER (event_type IN ('click', 'view')) AS passed,
  count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'signup')) AS failed, 0 AS skipped,
  CASE WHEN (event_id // 8) % 11 = 3 THEN 124 WHEN count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'signup')) > 0
    THEN 1 ELSE 0 END::BIGINT AS exit_code,
  (event_id // 8) % 11 = 3 AS timed_out, (event_id // 8) % 11 = 3 AS interrupted,
  (event_id // 8) % 11 <> 3 AND (event_id // 8) % 13 <> 5 AS complete, (event_id // 8) % 13 = 5 AS repository_changed, count(*) AS cases
FROM events GROUP BY event_id // 8"""

PAYLOAD_SQL = f"""
SELECT repository_id, complete, '{{"collection_errors":0,"complete":' || complete || ',"deselected":0,"discovered":' || discovered
  || ',"exit_code":' || exit_code || ',"failed":' || failed || ',"interrupted":' || interrupted || ',"passed":' || passed
  || ',"repository_changed":' || repository_changed || ',"runtime_errors":0,"schema_version":"1.0","selected":' || selected
  || ',"skipped":0,"test_cases":[' || tc || '],"timed_out":' || timed_out || ',"xfailed":0,"xpassed":0}}' AS payload
FROM ({RUNS_SQL}) JOIN (
  SELECT run_id, string_agg('{{"node_id":"' || node || '","outcome":"' || outcome || '"}}', ',' ORDER BY node COLLATE "C") AS tc
  FROM (SELECT event_id // 8 AS run_id, 'tests/t.py::test_' || user_id || '[' || event_id || ']' AS node,
    CASE event_type WHEN 'click' THEN 'passed' WHEN 'view' THEN 'passed' WHEN 'purchase' THEN 'skipped'
      WHEN 'signup' THEN 'xfailed' ELSE 'failed' END AS outcome FROM events) GROUP BY run_id) USING (run_id)"""
PAYLOAD_SQL = PAYLOAD_SQL.replace(' COLLATE "C"', "")

def findings_sql(exact: bool = False) -> str:
    signals = signals_sql(DOCUMENT_SAMPLES_SQL, "repository_id, path")
    sources = "(SELECT DISTINCT source AS repository_id FROM documents)"
    shown = """concat_ws('|',
     'efficiency:peak_rss_mb:' || printf('%+.4f', peak_rss_mb), 'efficiency:runtime_ms:' || printf('%+.4f', runtime_ms),
     'efficiency:throughput_per_second:' || printf('%+.4f', throughput_per_second))"""
    return f"""
WITH src AS (SELECT repository_id, NOT ends_with(repository_id, '1') AS intent, ends_with(repository_id, '2') AS claimed FROM {sources}),
sig AS (SELECT repository_id, count(*) AS n, count(*) FILTER (severity IN ('high', 'critical')) AS p,
  count(*) FILTER (severity = 'critical') AS c FROM ({signals}) GROUP BY ALL),
led AS ({LEDGER_SQL}),
runs AS (SELECT * REPLACE ('src' || repository_id AS repository_id) FROM ({RUNS_SQL}) WHERE NOT ends_with(repository_id, '2')),
pay AS (SELECT 'src' || repository_id AS repository_id, sha256(payload) AS h FROM ({PAYLOAD_SQL})),
eff AS (SELECT * REPLACE ('src' || repository_id AS repository_id) FROM ({efficiency_sql(0.2, 0.2, 0.2, 3, REFERENCES_SQL if exact else "")})),
qual AS (SELECT 'src' || c_custkey AS repository_id, * FROM ({QUALITY_SQL})),
arch AS (SELECT source AS repository_id, count(DISTINCT lang) AS m, count(*) AS e, count(*) FILTER (n_chars > 15000) AS cy FROM documents GROUP BY ALL)
SELECT repository_id, 'evidence_sufficiency' AS dimension, 'warn' AS status, 0.5::DOUBLE AS confidence, 'medium' AS severity,
  'REPOSITORY_CONTEXT_PARTIAL' AS tags, 'repository:' || repository_id AS refs,
  'Working-tree evidence lacks authoritative PR and specification context.' AS summary FROM src
UNION ALL SELECT repository_id, 'provenance', 'unknown', 0, 'info', 'PROVENANCE_UNCERTAIN', 'provenance:unavailable',
  'No verified provenance model or attestation was supplied.' FROM src
UNION ALL SELECT repository_id, 'intent_alignment', CASE WHEN intent THEN 'pass' ELSE 'unknown' END, CASE WHEN intent THEN 0.8 ELSE 0 END,
  CASE WHEN intent THEN 'info' ELSE 'medium' END, CASE WHEN intent THEN '' ELSE 'INTENT_UNVERIFIED' END,
  CASE WHEN intent THEN 'intent:user-supplied' ELSE 'intent:missing' END,
  CASE WHEN intent THEN 'Intent text is available for alignment review.' ELSE 'No issue, specification, or PR intent was supplied.' END FROM src
UNION ALL SELECT repository_id, 'evidence_integrity', status, confidence,
  CASE status WHEN 'fail' THEN 'critical' WHEN 'unknown' THEN 'medium' ELSE 'info' END, tags,
  CASE WHEN failed_artifacts > 0 THEN '' ELSE 'ledger:' || snapshot_id || ':verified' END,
  'Ledger integrity audit found ' || failed_artifacts || ' failed artifact(s).' FROM src JOIN led USING (repository_id)
UNION ALL SELECT repository_id, 'security_risk', CASE WHEN p > 0 THEN 'fail' ELSE 'pass' END, 0.7,
  CASE WHEN c > 0 THEN 'critical' WHEN p > 0 THEN 'high' ELSE 'info' END, '',
  CASE WHEN n > 0 THEN '' ELSE 'static-scan:no-findings' END,
  'Static scan found ' || coalesce(p, 0) || ' production and 0 test-only severe signal(s).' FROM src LEFT JOIN sig USING (repository_id)
UNION ALL SELECT repository_id, 'architectural_compatibility', CASE WHEN cy > 0 THEN 'fail' ELSE 'pass' END, 1,
  CASE WHEN cy > 0 THEN 'high' ELSE 'info' END, '',
  CASE WHEN cy > 0 THEN '' ELSE 'architecture:' || m || '-modules:' || e || '-edges:no-cycles' END,
  'Dependency analysis inspected ' || m || ' module(s), ' || e || ' edge(s), and found ' || cy || ' cycle(s).' FROM arch
UNION ALL SELECT repository_id, 'efficiency_risk', coalesce(status, 'unknown'), coalesce(confidence, 0),
  CASE status WHEN 'fail' THEN 'high' WHEN 'pass' THEN 'info' ELSE 'medium' END, '',
  CASE WHEN status IS NULL THEN 'efficiency:missing' ELSE {"refs" if exact else shown} END,
  CASE WHEN exceeded <> '' THEN 'Measured efficiency comparison exceeded: ' || replace(exceeded, ',', ', ') || '.'
    WHEN status = 'pass' THEN 'Measured efficiency comparison remained within configured budgets.'
    ELSE 'Efficiency measurements were missing or statistically insufficient.' END FROM src LEFT JOIN eff USING (repository_id)
UNION ALL SELECT repository_id, 'ood_evidence_quality', coalesce(status, 'unknown'), coalesce(confidence, 0),
  CASE status WHEN 'fail' THEN 'high' WHEN 'pass' THEN 'info' ELSE 'medium' END, coalesce(tags, ''),
  CASE WHEN status IS NULL THEN 'ood:missing' ELSE 'ood:' || detector_id || ':' || printf('%.4f', ood_score) END,
  CASE WHEN status IS NULL THEN 'No named OOD and evidence-integrity artifact was supplied.'
    ELSE 'Detector ' || detector_id || ' reported OOD=' || printf('%.3f', ood_score) || ' with context coverage=' || printf('%.3f', context_coverage) || '.' END
  FROM src LEFT JOIN qual USING (repository_id)
UNION ALL SELECT repository_id, 'functional_evidence', st, CASE st WHEN 'pass' THEN 0.9 WHEN 'warn' THEN 0.35 WHEN 'fail' THEN
    CASE WHEN k = 'mismatch' THEN 1 ELSE 0.9 END ELSE 0 END,
  CASE st WHEN 'pass' THEN 'info' WHEN 'fail' THEN 'high' ELSE 'medium' END,
  CASE k WHEN 'mismatch' THEN 'TEST_SNAPSHOT_MISMATCH' WHEN 'incomplete' THEN 'TEST_RUN_INCOMPLETE'
    WHEN 'claimed' THEN 'TEST_RESULT_UNVERIFIED' WHEN 'absent' THEN 'TEST_EVIDENCE_MISSING' ELSE 'TEST_EVIDENCE_OBSERVED' END,
  CASE k WHEN 'mismatch' THEN 'tests:snapshot-mismatch:snap_' || repository_id WHEN 'incomplete' THEN 'tests:' || h || ':incomplete'
    WHEN 'clean' THEN 'tests:' || h || ':observed' WHEN 'failed' THEN 'tests:' || h || ':failed'
    WHEN 'claimed' THEN 'tests:caller-asserted' ELSE 'tests:missing' END,
  CASE k WHEN 'mismatch' THEN 'Observed test artifact does not match the assessed code snapshot.'
    WHEN 'incomplete' THEN 'Observed pytest execution was incomplete.'
    WHEN 'clean' THEN 'Observed pytest 8: ' || passed || ' passed, 0 failed in 1.500s.'
    WHEN 'failed' THEN 'Observed pytest failed: ' || failed || ' failed, 0 errors, exit ' || exit_code || '.'
    WHEN 'claimed' THEN 'Test success was asserted by the caller without a snapshot-bound artifact.'
    ELSE 'No test execution evidence was supplied.' END
  FROM (SELECT *, CASE k WHEN 'mismatch' THEN 'fail' WHEN 'failed' THEN 'fail' WHEN 'clean' THEN 'pass' WHEN 'claimed' THEN 'warn' ELSE 'unknown' END AS st
    FROM (SELECT src.repository_id, passed, failed, exit_code, h, CASE
        WHEN runs.repository_id IS NOT NULL AND src.repository_id = 'src8' THEN 'mismatch' WHEN NOT complete THEN 'incomplete'
        WHEN exit_code = 0 AND failed = 0 THEN 'clean' WHEN exit_code IS NOT NULL THEN 'failed' WHEN claimed THEN 'claimed' ELSE 'absent' END AS k
      FROM src LEFT JOIN runs USING (repository_id) LEFT JOIN pay USING (repository_id)))"""


def references_sql() -> str:
    signals = signals_sql(DOCUMENT_SAMPLES_SQL, "repository_id, path")
    return f"""
SELECT repository_id, dimension, unnest(string_split(refs, '|')) AS reference FROM ({findings_sql(True)}) WHERE refs <> ''
UNION ALL SELECT repository_id, 'security_risk', path || ':' || line || ':' || rule_id FROM ({signals})
UNION ALL SELECT source, 'architectural_compatibility', 'docs/d' || doc_id || '.txt:ARCH-CYCLE' FROM documents WHERE n_chars > 15000
UNION ALL SELECT repository_id, 'evidence_integrity', 'artifact:' || artifact_id FROM ({ARTIFACTS_SQL}) WHERE real_hash <> content_hash"""


def routing_sql(findings: str, requests: str) -> str:
    """``findings``: rid, dimension, status, confidence, severity, tags (comma text);
    ``requests``: rid, target_id, target_kind, tags."""
    order = [
        "evidence_integrity", "evidence_sufficiency", "intent_alignment", "functional_evidence",
        "architectural_compatibility", "security_risk", "efficiency_risk", "ood_evidence_quality",
    ]

    def listed(items):
        return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"

    pivot = ", ".join(f"max(status) FILTER (dimension = '{d}') AS s_{d}" for d in order)
    gone = {d: f"(s_{d} IS NULL OR s_{d} = 'unknown')" for d in order}
    gone["functional_evidence"] = f"({gone['functional_evidence']} OR unverified)"
    missing = listed([f"CASE WHEN {gone[d]} THEN '{d}' END" for d in order])
    correctable = ("intent_alignment", "functional_evidence", "efficiency_risk")
    return f"""
WITH f AS ({findings}), r AS ({requests}),
p AS (SELECT rid, {pivot}, max(severity) FILTER (dimension = 'security_risk') AS sec,
  coalesce(bool_or(contains(tags, 'TEST_RESULT_UNVERIFIED')) FILTER (dimension = 'functional_evidence'), false) AS unverified,
  min(confidence) FILTER (dimension <> 'provenance') AS low, string_agg(tags, ',') AS ftags FROM f GROUP BY rid),
j AS (SELECT r.*, p.* EXCLUDE (rid, unverified), coalesce(unverified, false) AS unverified FROM r LEFT JOIN p USING (rid)),
m AS (SELECT *, {missing} AS missing FROM j),
t AS (SELECT *, list_sort(list_distinct(list_filter(string_split(concat_ws(',', tags, ftags,
    CASE WHEN list_contains(missing, 'functional_evidence') THEN 'TEST_EVIDENCE_MISSING' END), ','), lambda x: x <> ''))) AS all_tags FROM m),
k AS (SELECT *, CASE WHEN s_evidence_integrity = 'fail' THEN 'integrity'
  WHEN list_contains(all_tags, 'OOD_INPUT') OR s_ood_evidence_quality = 'fail' THEN 'ood'
  WHEN s_security_risk = 'fail' AND sec IN ('high', 'critical') THEN 'security'
  WHEN s_architectural_compatibility = 'fail' THEN 'architecture'
  WHEN {' OR '.join(f"s_{d} = 'fail'" for d in correctable)} THEN 'rewrite'
  WHEN len(missing) > 0 THEN 'missing' ELSE 'allow' END AS route FROM t)
SELECT rid AS repository_id, target_id, target_kind,
  CASE route {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in assess.ACTIONS.items())} END AS action,
  CASE route {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in assess.REASONS.items())} END AS action_reason,
  round(least(CASE WHEN len(missing) > 0 THEN 0 ELSE coalesce(low, 0) END,
    CASE WHEN list_contains(all_tags, 'OOD_INPUT') OR list_contains(all_tags, 'REPOSITORY_CONTEXT_PARTIAL') THEN 0.25 ELSE 1 END), {PLACES})::DOUBLE AS confidence,
  CASE route WHEN 'integrity' THEN 'evidence_integrity,evidence_sufficiency' WHEN 'ood' THEN 'evidence_sufficiency,ood_evidence_quality'
    WHEN 'security' THEN 'evidence_sufficiency,security_risk' WHEN 'architecture' THEN 'evidence_sufficiency,architectural_compatibility'
    WHEN 'rewrite' THEN array_to_string(list_concat(['evidence_sufficiency'], {listed([f"CASE WHEN s_{d} = 'fail' THEN '{d}' END" for d in correctable])}), ',')
    WHEN 'missing' THEN array_to_string(list_concat(['evidence_sufficiency'], missing), ',')
    ELSE array_to_string({listed([f"CASE WHEN s_{d} IS NOT NULL THEN '{d}' END" for d in order])}, ',') END AS decision_path,
  array_to_string(missing, ',') AS missing_evidence, array_to_string(all_tags, ',') AS tags FROM k"""


_names = (
    "['evidence_integrity', 'evidence_sufficiency', 'intent_alignment', 'functional_evidence', "
    "'architectural_compatibility', 'security_risk', 'efficiency_risk', 'ood_evidence_quality', 'provenance']"
)
ORDER_FINDINGS_SQL = f"""
SELECT rid, dimension, CASE WHEN q <= 3 THEN 'fail' WHEN q <= 6 THEN 'unknown' WHEN q <= 20 THEN 'warn' ELSE 'pass' END AS status,
  1 - d AS confidence, CASE f WHEN 'R' THEN 'critical' WHEN 'A' THEN 'high' ELSE 'low' END AS severity,
  CASE WHEN dimension = 'functional_evidence' AND f = 'N' THEN 'TEST_RESULT_UNVERIFIED'
       WHEN dimension = 'ood_evidence_quality' AND q > 48 THEN 'OOD_INPUT' ELSE '' END AS tags
FROM (SELECT l_orderkey::VARCHAR AS rid, {_names}[l_partkey % 9 + 1] AS dimension, min(l_quantity) AS q,
  max(l_discount) AS d, min(l_returnflag) AS f FROM lineitem GROUP BY ALL)"""
ORDER_REQUESTS_SQL = """
SELECT o_orderkey::VARCHAR AS rid, 'order:' || o_orderkey AS target_id,
  CASE WHEN o_orderstatus = 'F' THEN 'commit' ELSE 'pull_request' END AS target_kind,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT' ELSE '' END AS tags FROM orders"""

ORACLES = {
    "ledger_integrity": LEDGER_SQL,
    "failed_artifacts": f"""SELECT repository_id, 'snap_' || repository_id AS snapshot_id, sha256(repository_id) AS head_sha,
  artifact_id FROM ({ARTIFACTS_SQL}) WHERE real_hash <> content_hash""",
    "claim_missing_references": f"""
WITH refs AS (SELECT DISTINCT repository_id, claim_id, unnest(list_concat(evidence_refs, counter_evidence_refs)) AS artifact_id FROM ({CLAIMS_SQL}))
SELECT * FROM refs ANTI JOIN ({ARTIFACTS_SQL}) a USING (repository_id, artifact_id)""",
    "claim_violations": f"""
WITH c AS ({CLAIMS_SQL})
SELECT 'claims' AS "table", claim_id AS key, 'duplicate_key' AS rule, count(*)::VARCHAR AS detail FROM c GROUP BY claim_id HAVING count(*) > 1
UNION ALL SELECT 'claims', claim_id, 'domain:severity', severity FROM c WHERE severity NOT IN ('info', 'low', 'medium', 'high', 'critical')
UNION ALL SELECT 'claims', claim_id, 'blank:producer', '' FROM c WHERE trim(producer) = ''
UNION ALL SELECT 'claims', claim_id, 'unit_interval:confidence', confidence::DOUBLE::VARCHAR FROM c WHERE confidence > 1
UNION ALL SELECT 'claims', claim_id, 'timezone:created_at', created_at FROM c WHERE NOT ends_with(created_at, 'Z')
UNION ALL SELECT 'claims', claim_id, 'no_evidence_reference', '' FROM c WHERE len(evidence_refs) = 0
UNION ALL SELECT 'claims', claim_id, 'target_mismatch', repository_id || '|snap_' || repository_id || '|' || sha256(repository_id) FROM c
  WHERE repository_id NOT IN (SELECT source FROM documents WHERE source <> 'src7')""",
    "artifact_violations": """
SELECT 'lineitem' AS "table", l_orderkey || '|' || l_linenumber AS key, 'duplicate_key' AS rule, count(*)::VARCHAR AS detail
  FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'lineitem', l_orderkey || '|' || l_linenumber, 'sha256:digest', upper(sha256(l_partkey::VARCHAR)) FROM lineitem
  WHERE l_returnflag = 'R' AND regexp_matches(sha256(l_partkey::VARCHAR), '[a-f]')
UNION ALL SELECT 'lineitem', l_orderkey || '|' || l_linenumber, 'minimum:l_tax', l_tax::VARCHAR FROM lineitem WHERE l_tax <= 0
UNION ALL SELECT 'lineitem', l_orderkey || '|' || l_linenumber, 'minimum:l_linenumber', l_linenumber::VARCHAR FROM lineitem WHERE l_linenumber < 2""",
    "efficiency": efficiency_sql(0.02, 0.0, 0.02, 100),
    "evidence_quality": f"SELECT detector_id, status, confidence, tags FROM ({QUALITY_SQL})",
    "test_runs": f"SELECT * EXCLUDE (run_id) REPLACE (skipped::BIGINT AS skipped) FROM ({RUNS_SQL})",
    "outcome_counts": """
SELECT (event_id // 8)::VARCHAR AS repository_id, count(*) FILTER (event_type IN ('click', 'view')) AS passed,
  count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'signup')) AS failed,
  count(*) FILTER (event_type = 'purchase') AS skipped, count(*) FILTER (event_type = 'signup') AS xfailed,
  0::BIGINT AS xpassed, 0::BIGINT AS error FROM events GROUP BY ALL""",
    "test_artifacts": f"""SELECT repository_id, 'test_report' AS kind, complete, sha256(payload) AS content_hash, '2024-01-01T00:00:00+00:00' AS created_at,
  length(payload) AS size FROM ({PAYLOAD_SQL})""",
    "review_findings": f"""
WITH r AS (SELECT repository_id, dimension, count(*) AS reference_count FROM ({references_sql()}) GROUP BY ALL)
SELECT f.*, reference_count FROM ({findings_sql(True)}) f JOIN r USING (repository_id, dimension)""",
    "finding_references": references_sql(),
    "finding_violations": f"""
SELECT 'findings' AS "table", concat_ws('|', k, 'snap_' || k, sha256(k), dimension) AS key, 'duplicate_key' AS rule, count(*)::VARCHAR AS detail
FROM (SELECT l_orderkey::VARCHAR AS k, {_names}[l_partkey % 9 + 1] AS dimension FROM lineitem) GROUP BY k, dimension HAVING count(*) > 1""",
    "review_actions": routing_sql(
        f"SELECT repository_id AS rid, * EXCLUDE (repository_id) FROM ({findings_sql()})",
        "SELECT DISTINCT source AS rid, 'working-tree:' || source AS target_id, 'working_tree' AS target_kind, "
        "'REPOSITORY_CONTEXT_PARTIAL' AS tags FROM documents",
    ),
    "routed_orders": "SELECT * EXCLUDE (action_reason) FROM ("
    + routing_sql(ORDER_FINDINGS_SQL, ORDER_REQUESTS_SQL) + ")",
}
