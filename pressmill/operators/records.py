"""Generic record operators: latest state, first writer, duplicates, folds, positions, orphans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.session import durable


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last state of every key: rows delivered again collapse to the one with the greatest ``order``.

    Each task keeps one row of a key before the shuffle (the planner's window group limit), so a key delivered a million
    times never meets in one sort. Null order values are the smallest; exact ties are broken by the whole row.
    """
    kinds = dict(rows.dtypes)
    whole = F.xxhash64(*[F.col(c) for c in rows.columns if not kinds[c].startswith("map")])
    w = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order], whole.desc())
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def first_per(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first writer of every key wins (``min_by``, combined map-side)."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*key).agg(F.min_by(whole, F.struct(*order)).alias("_first")).select("_first.*")


def mark_repeats(rows: DataFrame, key: Sequence[str], order: Sequence[str], identifier: str) -> DataFrame:
    """Adds ``first_id`` and ``is_repeat``: a repeat points at the first row of its key.

    The first id comes from a map-side aggregate and a join, so a hot key is not sorted in one task.
    """
    first = rows.groupBy(*key).agg(F.min_by(identifier, F.struct(*order)).alias("first_id"))
    return rows.join(first, list(key)).withColumn("is_repeat", F.col("first_id") != F.col(identifier))


def fold_events(events: DataFrame, key: str, order: Sequence[str], start: Column, step) -> DataFrame:
    """D1 without its rules: the state of every key after its ordered events, as one JVM fold.

    ``step(state, event)`` gives the next state as a column. The events of one key are collected, so a key must
    be a bounded unit (an item's history); for open-ended keys use the streaming operator.
    """
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in events.columns if c not in order and c != key]]])
    logs = events.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("log"))
    return logs.select(key, F.aggregate("log", start, step).alias("state"), F.size("log").alias("n_events"))


def positions(rows: DataFrame, group: str, order: Sequence[Column], identifier: str) -> DataFrame:
    """Adds position (1-based), n_siblings, previous_id and next_id within a group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.select(
        group, identifier, F.row_number().over(w).cast("int").alias("position"), F.count(F.lit(1)).over(Window.partitionBy(group)).alias("n_siblings"),
        F.lag(identifier).over(w).alias("previous_id"), F.lead(identifier).over(w).alias("next_id"),
    )


def within_budget(rows: DataFrame, group: str, order: str, cost: Column, cap: int, separator: int = 2) -> DataFrame:
    """Rows of a group up to the first whose running cost exceeds ``cap``; costs are positive, so a prefix.

    Adds ``used``. Each row after the first costs ``separator`` more.
    """
    w = Window.partitionBy(group).orderBy(order)
    priced = rows.withColumn("_cost", cost + F.when(F.row_number().over(w) > 1, separator).otherwise(0))
    run = priced.withColumn("used", F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("used") <= cap).drop("_cost")


def orphans(stored: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Stored keys that nothing knows."""
    return stored.join(known, key, "left_anti")


def dangling(child: DataFrame, foreign: str, parent: DataFrame, primary: str, edge: str) -> DataFrame:
    """Referential check of one edge: child rows whose non-null key has no parent."""
    missing = child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(primary).alias(foreign)).distinct(), foreign, "left_anti")
    return missing.select(F.lit(edge).alias("edge"), F.col(foreign).alias("key"))


def violations(rows: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Keys that are not unique; keys with a null part are exempt, as in a unique index."""
    return rows.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(name).alias("constraint_name"), F.concat_ws("|", *key).alias("key"), "n")


def ordered_digests(rows: DataFrame, key: str, order: Sequence[Column], part: Column, separator: str, head: Column | None = None) -> DataFrame:
    """(key, n_rows, digest): SHA-256 over the ordered parts of every key, joined by ``separator`` after ``head``.

    Rows are sorted outside memory (Spark spills) and hashed as they pass, so a key of any size is digested whole and
    no list of it ever exists; SHA-256 is sequential, so one key's bytes pass through one task. Null parts are counted
    and left out. A key with several heads has a digest for each.
    """
    names = [f"o{i}" for i in range(len(order))]
    flat = rows.select(F.col(key).alias("k"), (F.lit(None).cast("string") if head is None else head).alias("h"), part.alias("p"), *[c.alias(n) for c, n in zip(order, names)])
    met = flat.repartition("k").sortWithinPartitions("k", "h", *[F.asc_nulls_last(n) for n in names]).select("k", "h", "p")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, digest, begun = None, 0, hashlib.sha256(), False
        for batch in batches:
            out = []
            for k, h, p in zip(batch["k"], batch["h"], batch["p"]):
                h = h if isinstance(h, str) else None
                if at != (k, h):
                    if at:
                        out.append((at[0], n, digest.hexdigest()))
                    at, n, digest, begun = (k, h), 0, hashlib.sha256((h or "").encode()), h is not None
                n += 1
                if isinstance(p, str):
                    digest.update(((separator if begun else "") + p).encode())
                    begun = True
            yield pd.DataFrame(out, columns=["k", "n", "d"])
        if at:
            yield pd.DataFrame([(at[0], n, digest.hexdigest())], columns=["k", "n", "d"])

    return met.mapInPandas(run, "k string, n bigint, d string").select(F.col("k").alias(key), F.col("n").alias("n_rows"), F.col("d").alias("digest"))


def numbered(rows: DataFrame, key: str, order: Sequence[str], name: str = "place") -> DataFrame:
    """Adds the place (from 1) of every row of its key, nulls last; a hot key is numbered in range pieces.

    Rows are range-partitioned by key and order; a row's place is the number of its key's rows in earlier pieces plus
    its place in its own, so no task holds more than a piece.
    """
    by = [F.asc_nulls_last(c) for c in order]
    pieces = durable(rows.repartitionByRange(F.col(key), *by).withColumn("_piece", F.spark_partition_id()))
    sizes = pieces.groupBy(key, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(key, "_piece").orderBy(*by))
    return pieces.withColumn("_within", within).join(starts, [key, "_piece"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_piece", "_start", "_within")
