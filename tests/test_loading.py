"""Loaders over text columns, canonical JSON, prefix sums and measured broadcasts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from revlens.functions import hashing
from revlens.operators import evaluate
from revlens.session import broadcast_if_bounded, materialise
from revlens.sources import documents


def test_canonical_text_sorts_keys_at_every_level(spark):
    texts = ['{"b": [ {"z": 1, "a": {"y": null, "x": "é/\\u00e9"}} ], "a": true, "B": ""}', "[]", '"s"', "no json", "", None]
    rows = spark.createDataFrame([(k, text) for k, text in enumerate(texts)], "k INT, text STRING").select("k", hashing.canonical_text(F.col("text")).alias("c")).collect()
    found = {row["k"]: row["c"] for row in rows}
    for k in (0, 1, 2):
        assert found[k] == json.dumps(json.loads(texts[k]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert found[3] is found[4] is found[5] is None


def test_documents_that_do_not_fit_are_rejected(spark):
    rows = [
        ("good", '{"baseline":{"runtime_ms":1.5},"candidate":{"repeats":3}}'), ("cut", '{"baseline":{"runtime_ms":1.5}'), ("null", None), ("empty", ""),
        ("list", "[1]"), ("other", '{"baseline":{},"candidate":{},"more":1}'), ("field", '{"baseline":{"cpu":1},"candidate":{}}'), ("kind", '{"baseline":{"runtime_ms":"x"},"candidate":{}}'),
    ]
    found, rejects = documents.parse_efficiency(spark.createDataFrame(rows, "source STRING, text STRING"))
    assert sorted((r["source"], r["side"], r["runtime_ms"], r["repeats"]) for r in found.collect()) == [("good", "baseline", 1.5, 1), ("good", "candidate", None, 3)]
    rules = {r["key"]: r["rule"] for r in rejects.collect()}
    assert set(rules) == {"cut", "null", "empty", "list", "other", "field", "kind"}
    assert rules["other"] == rules["field"] == "unsupported_fields" and rules["cut"] == rules["kind"] == "malformed"


def test_catalog_must_be_a_list_of_known_fields(spark):
    record = '{"dataset_id":"d","record_id":"r"}'
    rows = [("good", f"[{record}]"), ("bare", record), ("none", "[]"), ("field", '[{"record_id":"q","extra":1}]')]
    found, rejects = documents.parse_catalog(spark.createDataFrame(rows, "source STRING, text STRING"))
    assert [r["record_id"] for r in found.collect()] == ["r"]
    assert {r["key"]: r["rule"] for r in rejects.collect()} == {"bare": "schema_change", "field": "unsupported_fields"}


@pytest.mark.parametrize("rows_in_range", [7, 1000])
def test_running_totals_over_many_ranges(spark, rows_in_range):
    draw = random.Random(2)
    rows = [(group, float(order), draw.randrange(5)) for group, size in (("a", 100), ("b", 3), ("c", 1)) for order in draw.sample(range(1000), size)]
    frame = spark.createDataFrame(rows, "g STRING, o DOUBLE, v BIGINT")
    got = {(r["g"], r["o"]): r["below_v"] for r in evaluate.running_totals(frame, "g", "o", ("v",), rows_in_range).collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}
    assert evaluate.running_totals(frame.limit(0), "g", "o", ("v",), rows_in_range).collect() == []


def test_sections_are_in_order_as_a_whole(spark, tmp_path):
    rows = [(f"k{k % 7}", k * 37 % 500) for k in range(500)]
    frame = spark.createDataFrame(rows, "name STRING, number INT").repartition(4)
    documents.write_json(frame, f"{tmp_path}/out", ("name", "number"))
    back = documents.read_in_order(spark, f"{tmp_path}/out", "name STRING, number INT").orderBy("_place").collect()
    assert [(r["name"], r["number"]) for r in back] == sorted(rows)


def test_broadcast_needs_few_rows_and_few_bytes(spark):
    stored = materialise(spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("text")))
    hinted = lambda frame: "broadcast" in frame._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(broadcast_if_bounded(stored))
    assert not hinted(broadcast_if_bounded(stored, byte_limit=40_000)) and not hinted(broadcast_if_bounded(stored, row_limit=49))


def test_rows_to_be_ordered_are_computed_once(spark, tmp_path):
    """Finding ranges takes a pass of its own, which must not run the query a second time."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.range(1000, numPartitions=4).mapInArrow(counted, "id LONG")
    documents.write_json(frame, f"{tmp_path}/out", ("id",))
    assert seen.value == 1000
    back = documents.read_in_order(spark, f"{tmp_path}/out", "id LONG").orderBy("_place").collect()
    assert [row["id"] for row in back] == list(range(1000))
