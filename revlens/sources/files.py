"""Repository files as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..schemas import TARGET

MAX_SAMPLE_BYTES = 250_000


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, content`` below ``root``; filters on ``length`` reach the scan."""
    prefix = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.substr("path", F.locate(prefix, F.col("path")) + len(prefix))
    return raw.select(relative.alias("path"), "length", "content")


def decode(content) -> F.Column:
    """UTF-8 text with replacement marks for undecodable bytes."""
    return F.make_valid_utf8(content.cast("string"))


def is_text(content) -> F.Column:
    """Whether bytes are UTF-8 as they stand."""
    return F.is_valid_utf8(content.cast("string"))


def readable_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with their text as ``code``, and those whose bytes are no UTF-8 with the reason."""
    good = files.filter(is_text(F.col("content"))).withColumn("code", F.col("content").cast("string")).drop("content")
    bad = files.filter(~is_text(F.col("content"))).drop("content").withColumn("reason", F.lit("undecodable content"))
    return good, bad


def code_samples(files: DataFrame, keys: Sequence[str] = TARGET, max_bytes: int | None = None) -> DataFrame:
    """Supported files as samples, with ``max_bytes`` only those up to that size.

    ``files`` hold ``keys, path, length`` and ``content`` (bytes) or ``code`` (text).
    """
    code = F.col("code") if "code" in files.columns else decode(F.col("content"))
    language = paths.language_of(F.col("path"))
    small = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    return small.filter(language.isNotNull()).select(
        *keys,
        hashing.sample_id(F.col("repository_id"), F.col("path")).alias("sample_id"),
        F.col("repository_id").alias("group_id"),
        language.alias("language"),
        code.alias("code"),
        "path",
    )


def python_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").endswith(".py"))


def side_files(files: DataFrame, side: str) -> DataFrame:
    """Base or head text of changed files; files without text on a side are absent."""
    return files.filter((F.col("side") == side) & F.col("code").isNotNull()).drop("side")
