from revlens.operators import gates, security


def test_row_local_operators_run_on_a_stream(spark, tmp_path):
    code = tmp_path / "code"
    spark.createDataFrame([("a.py", "eval(x)\n"), ("b.py", "y")], "path STRING, code STRING").write.parquet(str(code))
    stream = spark.readStream.schema("path STRING, code STRING").parquet(str(code))
    query = security.scan_code(stream).writeStream.format("memory").queryName("signals").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("signals").select("path", "rule_id", "line").collect()] == [("a.py", "PY-EVAL", 1)]


def test_quality_gate_on_a_stream(spark, tmp_path):
    schema = "detector_id STRING, ood_score DOUBLE, context_coverage DOUBLE, schema_supported BOOLEAN"
    spark.createDataFrame([("d", 0.9, 0.9, True)], schema).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "q"))
    query = gates.evidence_quality(stream).writeStream.format("memory").queryName("quality").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("quality").first()["status"] == "fail"
