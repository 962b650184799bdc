import pytest
from pyspark.sql import functions as F

from revlens.operators import assess, evidence, gates, validation
from revlens.schemas import ACTION_DIMENSIONS, DIMENSIONS, FINDINGS
from revlens.plans import assessment

KEYS = "repository_id STRING, snapshot_id STRING, head_sha STRING"
MEASURES = f"{KEYS}, runtime_ms DOUBLE, peak_rss_mb DOUBLE, throughput_per_second DOUBLE, repeats BIGINT"


def compare(spark, target, before, after):
    frames = [spark.createDataFrame([(*target, *row)], MEASURES) for row in (before, after)]
    return gates.compare_efficiency(*frames).first()


def test_efficiency_gate(spark, target):
    good = compare(spark, target, (100.0, 200.0, 50.0, 5), (105.0, 205.0, 49.0, 5))
    assert good["status"] == "pass" and good["confidence"] == 1.0
    bad = compare(spark, target, (100.0, 200.0, 50.0, 5), (140.0, 260.0, 35.0, 5))
    assert bad["status"] == "fail" and bad["exceeded"] == ["peak_rss_mb", "runtime_ms", "throughput_per_second"]
    single = compare(spark, target, (100.0, None, None, 1), (100.0, None, None, 1))
    assert single["status"] == "unknown" and single["confidence"] == pytest.approx(0.2)
    assert single["deltas"] == {"runtime_ms": 0.0}
    edge = compare(spark, target, (100.0, None, None, 3), (120.0, None, None, 9))
    assert edge["status"] == "pass" and edge["confidence"] == pytest.approx(0.6)
    with pytest.raises(validation.ValidationError):
        gates.EfficiencyBudget(max_runtime_regression=1.5)


def test_quality_gate(spark):
    rows = [("a", 0.2, 0.9, True), ("b", 0.85, 0.9, True), ("c", 0.2, 0.9, False), ("d", 0.9, 0.1, True), ("e", 0.7, 0.8, True)]
    frame = spark.createDataFrame(rows, "detector_id STRING, ood_score DOUBLE, context_coverage DOUBLE, schema_supported BOOLEAN")
    got = {r["detector_id"]: r for r in gates.evidence_quality(frame).collect()}
    assert (got["a"]["status"], round(got["a"]["confidence"], 6)) == ("pass", 0.8)
    assert got["b"]["status"] == "fail" and got["b"]["tags"] == ["OOD_INPUT"]
    assert (got["c"]["status"], got["c"]["confidence"]) == ("unknown", 0.0)
    assert got["d"]["tags"] == ["OOD_INPUT", "REPOSITORY_CONTEXT_PARTIAL"] and got["d"]["status"] == "unknown"
    assert got["e"]["status"] == "fail"


def artifacts(spark, target, rows):
    frame = spark.createDataFrame(
        [(*target, *row) for row in rows],
        f"{KEYS}, artifact_id STRING, payload STRING, attestation STRING, complete BOOLEAN, bad BOOLEAN")
    digest = F.sha2("payload", 256)
    return frame.withColumn("content_hash", F.when(F.col("bad"), F.reverse(digest)).otherwise(digest))


@pytest.mark.parametrize("rows, status, confidence, tags", [
    ([], "unknown", 0.0, ["EVIDENCE_INTEGRITY_UNKNOWN"]),
    ([("a", "x", "observed", True, False)], "pass", 0.9, []),
    ([("a", "x", "observed", True, False), ("b", "y", "asserted", True, True)], "fail", 1.0, ["EVIDENCE_INTEGRITY_FAILED"]),
    ([("a", "x", "asserted", True, False)], "unknown", 0.0, ["EVIDENCE_ATTESTATION_INSUFFICIENT"]),
    ([("a", "x", "verified", False, False)], "unknown", 0.0, ["EVIDENCE_ATTESTATION_INSUFFICIENT"]),
])
def test_ledger_integrity(spark, target, rows, status, confidence, tags):
    ledgers = spark.createDataFrame([target], KEYS)
    got = evidence.ledger_integrity(artifacts(spark, target, rows), ledgers).first()
    assert (got["status"], got["confidence"], got["tags"]) == (status, confidence, tags)


def request(spark, target, overrides=None, omit=(), tags=()):
    status = {name: ("pass", 0.9, "info", []) for name in DIMENSIONS} | (overrides or {})
    rows = [
        (*target, name, value[0], value[1], value[2], "", [], value[3]) for name, value in status.items() if name not in omit
    ]
    findings = spark.createDataFrame(rows, FINDINGS)
    targets = spark.createDataFrame([(*target, "pr", "pull_request", list(tags))], f"{KEYS}, target_id STRING, target_kind STRING, tags ARRAY<STRING>")
    return assess.assess(findings, targets).first()


def test_repeated_dimension_is_listed_and_not_routed(spark, target):
    rows = [(*target, name, status, 0.5, "info", "", [], []) for name, status in (("security_risk", "pass"), ("security_risk", "fail"))]
    findings = spark.createDataFrame(rows, FINDINGS)
    targets = spark.createDataFrame([(*target, "pr", "pull_request", [])], f"{KEYS}, target_id STRING, target_kind STRING, tags ARRAY<STRING>")
    assert assess.assess(findings, targets).count() == 0
    listed = validation.repeated_findings(findings).collect()
    assert [(r["rule"], r["detail"]) for r in listed] == [("duplicate_key", "2")]
    assert assess.assess(findings.limit(0), targets).first()["action"] == "request_targeted_evidence"


def test_healthy_request_is_allowed(spark, target):
    got = request(spark, target, {"provenance": ("unknown", 0.0, "info", ["PROVENANCE_UNCERTAIN"])})
    assert got["action"] == "allow_standard_review" and got["confidence"] == pytest.approx(0.9)
    assert got["decision_path"] == list(ACTION_DIMENSIONS) and got["missing_evidence"] == []


@pytest.mark.parametrize("overrides, action, path", [
    ({"evidence_integrity": ("fail", 1.0, "critical", [])}, "block_pending_evidence", ["evidence_integrity", "evidence_sufficiency"]),
    ({"security_risk": ("fail", 0.9, "critical", []), "functional_evidence": ("fail", 0.9, "high", [])},
     "require_security_review", ["evidence_sufficiency", "security_risk"]),
    ({"architectural_compatibility": ("fail", 1.0, "high", [])}, "require_architecture_review", ["evidence_sufficiency", "architectural_compatibility"]),
    ({"functional_evidence": ("fail", 0.9, "high", []), "efficiency_risk": ("fail", 0.5, "high", [])},
     "require_human_rewrite_or_validation", ["evidence_sufficiency", "functional_evidence", "efficiency_risk"]),
    ({"ood_evidence_quality": ("fail", 0.1, "high", ["OOD_INPUT"])}, "block_pending_evidence", ["evidence_sufficiency", "ood_evidence_quality"]),
    ({"security_risk": ("fail", 0.9, "low", [])}, "allow_standard_review", list(ACTION_DIMENSIONS)),
])
def test_routing_order(spark, target, overrides, action, path):
    got = request(spark, target, overrides)
    assert (got["action"], got["decision_path"]) == (action, path)


def test_missing_tests_ask_for_evidence(spark, target):
    got = request(spark, target, {"functional_evidence": ("unknown", 0.0, "medium", [])})
    assert got["action"] == "request_targeted_evidence" and got["missing_evidence"] == ["functional_evidence"]
    assert "TEST_EVIDENCE_MISSING" in got["tags"] and got["confidence"] == 0.0


def test_omitted_dimension_and_caller_claim(spark, target):
    got = request(spark, target, omit=("efficiency_risk",))
    assert got["action"] == "request_targeted_evidence" and got["missing_evidence"] == ["efficiency_risk"]
    claimed = request(spark, target, {"functional_evidence": ("warn", 0.35, "medium", ["TEST_RESULT_UNVERIFIED"])})
    assert claimed["missing_evidence"] == ["functional_evidence"]


def test_ood_tag_blocks_and_caps_confidence(spark, target):
    got = request(spark, target, tags=["OOD_INPUT"])
    assert got["action"] == "block_pending_evidence" and got["confidence"] == pytest.approx(0.25)


def test_working_tree_requests_are_partial(spark, target):
    frame = assessment.working_tree_requests(spark.createDataFrame([target], KEYS)).first()
    assert frame["target_id"] == "working-tree:repo" and frame["tags"] == ["REPOSITORY_CONTEXT_PARTIAL"]


def test_runs_of_another_state_fail(spark, target):
    run = ("repo", "other", "head", True, 3, 0, 0, 3, 0, 0.5, "8", "r" * 64)
    runs = spark.createDataFrame([run], f"{KEYS}, complete BOOLEAN, selected BIGINT, exit_code BIGINT, failed BIGINT, passed BIGINT, "
                                 "runtime_errors BIGINT, duration_seconds DOUBLE, framework_version STRING, report_hash STRING")
    targets = spark.createDataFrame([(*target, True)], f"{KEYS}, tests_passed BOOLEAN")
    got = assess.functional_finding(targets, runs).first()
    assert got["status"] == "fail" and got["tags"] == ["TEST_SNAPSHOT_MISMATCH"] and got["confidence"] == 1.0
    own = runs.withColumns({"snapshot_id": F.lit(target[1]), "head_sha": F.lit(target[2])}).unionByName(runs)
    got = assess.functional_finding(targets, own).first()
    assert got["status"] == "pass" and got["summary"] == "Observed pytest 8: 3 passed, 0 failed in 0.500s."
    none = assess.functional_finding(targets, runs.limit(0)).first()
    assert none["status"] == "warn" and none["evidence_refs"] == ["tests:caller-asserted"]


def test_strict_validation(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", " ")], "id STRING, name STRING")
    with pytest.raises(validation.ValidationError):
        validation.require_clean(validation.duplicates(frame, "t", ("id",)))
    assert validation.blank_text(frame, "t", ("id",), "name").count() == 1
    validation.require_clean(validation.not_in_domain(frame, "t", ("id",), "id", ("a", "b")))
    stamps = spark.createDataFrame([("1", "2024-01-01T00:00:00+02:00"), ("2", "2024-01-01T00:00:00")], "id STRING, created_at STRING")
    assert [r["key"] for r in validation.naive_timestamp(stamps, "t", ("id",)).collect()] == ["2"]


def test_changes_show_four_places_of_their_unrounded_values(spark):
    """0.1234498 is 0.123450 with six places; 1/32 is a half exactly and goes to the even digit."""
    import duckdb

    from bindings import evidence_queries
    from revlens.operators import assess

    connection = duckdb.connect()
    connection.execute("""CREATE TABLE lineitem AS SELECT * FROM (VALUES
        (1, 10000.0::DOUBLE, 32.0::DOUBLE, TIMESTAMP '1997-01-01'), (1, 11234.498, 33.0, TIMESTAMP '1998-02-01')
        ) t(l_suppkey, l_extendedprice, l_quantity, l_shipdate)""")
    sql = evidence_queries.efficiency_sql(0.2, 0.2, 0.2, 3, evidence_queries.REFERENCES_SQL)
    shown = connection.execute(f"SELECT refs FROM ({sql})").fetchone()[0].split("|")
    assert [text.rsplit(":", 1)[1] for text in shown] == ["+0.0312", "+0.1234", "+0.0312"]
    values = spark.createDataFrame([(0.03125,), (0.1234498,), (-0.03125,), (0.09375,)], "v DOUBLE")
    assert [row[0] for row in values.select(assess.signed_decimal(F.col("v"))).collect()] == ["+0.0312", "+0.1234", "-0.0312", "+0.0938"]
