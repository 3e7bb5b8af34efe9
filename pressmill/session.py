"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "pressmill", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries are written for (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_base(spark: SparkSession, local_name: str) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where it is unset, a local session (tests, a laptop) has a
    folder of its own, and a cluster is an error: a machine's own folder would not be shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return os.path.join(tempfile.gettempdir(), local_name)


def shared_folder(spark: SparkSession) -> str:
    """A new folder all executors can reach, below ``shared_base``."""
    base = shared_base(spark, "pressmill-shared")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint.

    The folder is ``shared_base``'s; ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes what is no longer used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(spark, "pressmill-checkpoints"))
    return df.checkpoint(eager=True)
