"""What a shuffle carries: digests in place of three text keys, raw bytes in place of hexadecimal text."""

import re

import pytest

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return registered.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["change_features", "change_contexts"])
def test_changes_are_shuffled_by_digest(spark, name):
    assert "hashpartitioning(repository_id" not in plan_of(spark, name)


def test_findings_are_routed_by_digest(spark):
    plan = plan_of(spark, "routed_orders")
    assert "hashpartitioning(repository_id" not in plan and "hashpartitioning(_target" in plan


def test_untracked_entries_are_made_after_the_shuffle(spark):
    plan = plan_of(spark, "snapshots")
    assert "UNTRACKED" not in plan and "partial_collect_list(struct(_range" in plan


def test_packed_keys_come_back_and_nulls_match_nothing(spark):
    from revlens.functions import hashing

    rows = spark.createDataFrame([("a", "bc", 1), ("ab", "c", 2), (None, "c", 3)], "x string, y string, v int")
    back = hashing.unpack(hashing.pack(rows, ["x", "y"]), rows, ["x", "y"])
    assert sorted(map(tuple, back.collect())) == [("a", "bc", 1), ("ab", "c", 2)]


def test_symbols_are_looked_up_in_a_stored_table(spark):
    assert "max_by(symbol_id" not in plan_of(spark, "dependency_edges")


def test_dependencies_are_shuffled_by_digest_without_lists(spark):
    plan = plan_of(spark, "dependency_edges")
    assert "hashpartitioning(repository_id" not in plan and "hashpartitioning(_target" in plan
    assert not [line for line in plan.splitlines() if "Join" in line and "path" in line]


def test_impacts_are_shuffled_by_digest(spark):
    plan = plan_of(spark, "dependency_impacts")
    assert not re.search(r"hashpartitioning\(repository_id[^)]*(symbol_id|seed)", plan) and "hashpartitioning(_target" in plan


def test_a_module_of_two_files_belongs_to_the_later_path(spark, target):
    from revlens.operators import graph, structure
    from revlens.session import materialise

    files = [(*target, "pkg/a.py", "import one\n"), (*target, "pkg/a/__init__.py", "import two\n"), (*target, "pkg/b.py", "import three\n")]
    rows = spark.createDataFrame(files, "repository_id STRING, snapshot_id STRING, head_sha STRING, path STRING, code STRING")
    facts = materialise(structure.python_facts(rows))
    edges = graph.dependency_edges(facts, structure.symbols(facts)).collect()
    assert sorted(row["expression"] for row in edges) == ["three", "two"]
