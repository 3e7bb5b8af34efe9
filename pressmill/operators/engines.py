"""Seams for external engines (image preparation, recognition, language models) and adapters of older outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Engine = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def run_engine(requests: DataFrame, engine: Engine, schema: str, recorded: DataFrame, key: str = "request_hash", at_once: int | None = None) -> DataFrame:
    """Results of an engine for requests without a recorded result, beside the recorded ones.

    ``engine`` maps Arrow batches to rows of ``schema`` (which holds ``key``); as Spark repeats lost tasks, it must
    give the same result for the same request. Equal requests run once. ``at_once`` bounds the tasks that call an
    external service at the same time.
    """
    known = recorded.select(key).distinct()
    open_ = requests.dropDuplicates([key]).join(known, key, "left_anti")
    if at_once:
        open_ = open_.coalesce(at_once)
    return recorded.select(*[c.strip().split(" ")[0] for c in schema.split(",")]).unionByName(open_.mapInPandas(engine, schema))


def legacy_blocks(outputs: DataFrame) -> DataFrame:
    """A legacy output as one block without a box, its word confidence as a number; empty texts give no block."""
    from pressmill.functions.geometry import label_confidence
    from pressmill.functions.text import line_count

    block = F.struct(
        F.lit(1).alias("id"), F.col("text").alias("text"), F.lit(None).cast("array<int>").alias("box"), F.lit("none").alias("box_source"),
        label_confidence(F.col("confidence")).alias("confidence"), line_count(F.col("text")).alias("line_count"), F.lit("page=1").alias("source_ref"),
    )
    return outputs.select("id", "item_id", F.array_compact(F.array(F.when(F.trim("text") != "", block))).alias("blocks"))


def origin(engine: Column) -> Column:
    """Whether rules or a model read an advertisement."""
    return F.when(engine.isNull(), "legacy_import").when(engine.contains("rule"), "ocr_heuristic").otherwise("llm_extraction")


def operator_id(value: Column) -> Column:
    """Whether an operator id has the accepted shape; null has not."""
    return F.coalesce(value.rlike(r"^[A-Za-z0-9._@+-]{1,64}$"), F.lit(False))
