"""Physical plans the operators are meant to have."""

import pytest
from pyspark.sql import functions as F

from bindings import change_queries, inputs
from revlens import session
from revlens.operators import features, ownership, reuse, security, structure
from revlens.sources import git_text

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def samples(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    return inputs.with_target(documents, F.col("source")).select(
        "repository_id", F.col("doc_id").alias("sample_id"), F.col("text").alias("code"), F.col("lang").alias("language"),
        F.lit("p").alias("path"), F.lit("").alias("commit_message"),
        *[F.lit(0).cast("long").alias(name) for name in ("files_changed", "additions", "deletions")],
    )


def test_row_local_operators_do_not_shuffle(samples):
    for frame in (security.scan_code(samples), features.sample_features(samples), reuse.with_shingles(samples)):
        assert "Exchange" not in plan(frame)


def test_scans_read_only_needed_columns(samples):
    text = plan(security.scan_code(samples.select("sample_id", "code")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    counted = plan(features.language_counts(samples, ["repository_id"]))
    assert "ReadSchema: struct<lang:string,source:string>" in counted


def test_arrays_are_computed_once_below_explode(samples):
    text = reuse.reuse_index(samples)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("sha2") == 1


def test_newest_commits_limits_before_the_shuffle(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select(
        F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("commit_sha"), F.col("o_orderdate").alias("timestamp"))
    assert "WindowGroupLimit" in plan(git_text.newest_commits(orders, 3))


def test_no_product_joins(spark):
    pages = change_queries.changed_pages(spark, SF)
    owned = ownership.path_owners(pages, change_queries.parsed_owners(spark, SF))
    for frame in (owned, ownership.symbol_owners(pages.withColumn("symbol_id", F.lit("s")), owned)):
        text = plan(frame)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_line_joins_are_equality_joins(spark):
    keys = "repository_id STRING, snapshot_id STRING, head_sha STRING, path STRING"
    ranges = spark.createDataFrame([], f"{keys}, qualified_name STRING, kind STRING, start_line BIGINT, end_line BIGINT")
    points = spark.createDataFrame([], f"{keys}, line BIGINT")
    assert "NestedLoop" not in plan(structure.innermost_symbols(points, ranges))
    hunks = spark.createDataFrame([], f"{keys}, old_start BIGINT, old_lines BIGINT, new_start BIGINT, new_lines BIGINT")
    assert "NestedLoop" not in plan(structure.overlapping_hunks(hunks, ranges, "head"))


class StubSession:
    """A session of a cluster, with or without a shared folder."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


def test_shared_folder_comes_from_the_session(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "shared")
    assert session.shared_folder(StubSession(folder)) == folder
    with pytest.raises(RuntimeError):
        session.shared_folder(StubSession(None))
    monkeypatch.setattr(session, "shared_folder", lambda _: folder)
    assert session.materialise(spark.range(5), "numbers").count() == 5
    assert len(list((tmp_path / "shared").iterdir())) == 1
