"""Table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Spread rows over all cores before a costly row-wise stage when its scan has too few splits for them.

    Such a stage runs one task a split, and a Parquet file of a few megabytes is one split whatever its rows
    cost. A scan with at least a split for every core is left alone: large inputs are never shuffled for this.
    ``scan`` is the table ``df`` comes from, where ``df`` itself holds joins or aggregates and would be planned for the count.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if (df if scan is None else scan).rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def md5_key(*columns: str) -> Column:
    """A stable hash of several columns, nulls told apart from empty strings."""
    return F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)])))
