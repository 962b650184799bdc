"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side must be proven smaller than this many rows, and its stored columns than this many bytes.
BROADCAST_ROW_LIMIT = 500_000
BROADCAST_BYTE_LIMIT = 32 << 20


def build_session(app_name: str = "revlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the adaptive settings the operators are planned for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, so that their Python need not have it installed."""
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, else a local test folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a frame feeds several consumers or a loop round. The table lives in
    shared storage, so a lost executor costs a task retry and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/revlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class TwoSlots:
    """Storage of a loop that needs only its last table.

    Tables are written to two folders in turn, each replacing the one before the last, so
    a long loop holds two tables and not all of them. A frame read from here is valid
    until the second store after its own.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = f"{shared_folder(spark).rstrip('/')}/revlens-{name}-{uuid.uuid4().hex}"
        self._paths = [f"{base}-0", f"{base}-1"]

    def store(self, df: DataFrame) -> DataFrame:
        path = self._paths[0]
        df.write.mode("overwrite").parquet(path)
        self._paths.reverse()
        return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    Meant for plain scans that feed heavy per-row text work. A large table has
    more splits than cores already and passes through without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def broadcast_if_bounded(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT, byte_limit: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Hint a broadcast only after measuring ``df``; above either limit the join shuffles.

    ``df`` must be a stored table or a projection of one, so that measuring it is one scan of a few columns:
    its bytes are those its text columns have, each other column counted as 16.
    """
    texts = [field.name for field in df.schema.fields if field.dataType.typeName() in ("string", "binary")]
    long = [F.coalesce(F.octet_length("`" + name.replace("`", "``") + "`"), F.lit(0)) for name in texts]
    held = sum(long, F.lit(16 * (len(df.columns) - len(texts))))
    measured = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(held.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if measured[0] <= row_limit and measured[1] <= byte_limit else df


class Grown:
    """Stored table to which a loop adds rows step by step, each step in a folder of its own."""

    def __init__(self, first: DataFrame, name: str) -> None:
        self._spark, self._schema, self._steps = first.sparkSession, first.schema, 0
        self._base = f"{shared_folder(self._spark).rstrip('/')}/revlens-{name}-{uuid.uuid4().hex}"
        self.last = self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Stores ``rows`` and gives them back as read."""
        path = f"{self._base}/step={self._steps}"
        rows.select(*self._schema.names).write.parquet(path)
        self._steps += 1
        self.last = self._spark.read.schema(self._schema).parquet(path)
        return self.last

    def all(self) -> DataFrame:
        """All rows so far, as one scan."""
        return self._spark.read.schema(self._schema).parquet(*[f"{self._base}/step={step}" for step in range(self._steps)])
