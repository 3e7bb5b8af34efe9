"""Streams drained once, so that they can be compared with the batch result."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pressmill.io import table
from pressmill.plans.registry import Registry
from pressmill.session import shared_folder
from pressmill.streaming import ingest

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("z3_streamed_once", "SELECT id, count(*)::bigint AS n FROM (SELECT DISTINCT id FROM ingestion_items) GROUP BY id")
def streamed_once(spark, sf_dir):
    """The items table read as a file stream, deliveries made unique by key, drained into an idempotent sink."""
    batch = table(spark, sf_dir, "ingestion_items").select("id", "status", "ingested_at")
    path = f"{sf_dir}/ingestion_items.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, "ingestion_items").schema)
    stream = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "ingestion_items.parquet").parquet(sf_dir)
    folder = shared_folder(spark)
    ingest.drain(ingest.once_each(stream.select("id", "status", "ingested_at"), "id", "ingested_at", "3650 days"), f"{folder}/rows", f"{folder}/state")
    rows = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
