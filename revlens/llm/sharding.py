"""Shards by rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair draws a number from a hash; the shard with the least ``-ln(u) / weight``
wins. A draw depends on nothing but the key and the shard's number, so one more shard takes rows
only into itself, and each shard gets its weight's part of the keys.

Defined cases: a null key is the key of the empty string; repeated keys share a shard; a null
text has no bytes; an empty table gives an empty table. Columns named like an output column
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_BYTES = 16


def _draw(hashed: Column) -> Column:
    """Uniform in (0, 1) from the upper 53 bits of a hash."""
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number of the winning shard of each key; equal scores go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    base = F.xxhash64(F.coalesce(key.cast("string"), F.lit("")))
    scores = [
        F.struct((-F.log(_draw(F.xxhash64(base, F.lit(number)))) / F.lit(float(weight))).alias("score"),
                 F.lit(number).alias("shard"))
        for number, weight in enumerate(weights)
    ]
    return F.array_min(F.array(*scores))["shard"]


def with_slots(rows: DataFrame, shard: str, order: Sequence[Column]) -> DataFrame:
    """Adds ``slot``, gapless from 0 in every shard, without sorting a whole shard in one task.

    A shard is cut by a hash of the row into about as many buckets as a bucket has rows;
    rows are numbered inside buckets and shifted by the rows of the buckets before.
    """
    shards = rows.select(shard).distinct().count()
    buckets = max(1, math.ceil(math.sqrt(rows.count() / max(1, shards))))
    cut = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
        .select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order)) - 1
    return (
        cut.withColumn("_place", inside).join(shifts, [shard, "_bucket"])
        .withColumn("slot", (F.col("_place") + F.col("_shift")).cast("long"))
        .drop("_bucket", "_place", "_shift")
    )


def shard_documents(documents: DataFrame, key: str = "doc_id", text: str = "text",
                    weights: Sequence[float] = (1.0,) * 40, next_weight: float = 1.0) -> DataFrame:
    """Key, size, text checksum, shard, slot, and the shard with one shard more."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(key),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col(key), weights).alias("shard"),
        rendezvous_shard(F.col(key), [*weights, next_weight]).alias("grown_shard"),
    )
    return with_slots(rows, "shard", [F.col(key), F.col("text_crc32"), F.col("size")])


def write_shards(documents: DataFrame, path: str, key: str = "doc_id",
                 weights: Sequence[float] = (1.0,) * 40, files_per_shard: int = 1) -> None:
    """Writes whole rows as Parquet, one folder for each shard, each dealt over its files."""
    rows = documents.withColumn("shard", rendezvous_shard(F.col(key), weights))
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_shard))
    rows.repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)
