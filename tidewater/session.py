"""Session factory and table loader shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def build_session(cores: int | str = "*", app: str = "tidewater", shuffle_partitions: int = 8) -> SparkSession:
    """Local session with the settings every plan here assumes (UTC, Arrow, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEWATER_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; zone-less timestamps stay zone-less so results compare with plain SQL engines."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables up to this size may be dealt out over the cores; larger ones have row groups enough.
SPREAD_BYTES = 256 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A plain scan in at least as many partitions as there are cores, if it is small: few row groups would leave them
    idle. A larger one is read as it lies, whatever the number of cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= SPREAD_BYTES and rows.rdd.getNumPartitions() < cores else rows


def as_timestamp(df: DataFrame, *cols: str) -> DataFrame:
    """Casts zone-less columns to instants under the session zone (UTC)."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which every executor reaches. Where none is set, as in tests, a
    local session takes one of its own; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
