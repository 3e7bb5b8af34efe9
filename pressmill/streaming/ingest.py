"""Incremental ingestion: file stream, deduplication, keyed leases, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_items(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """New item files as a stream; the file source is the poller."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once_each(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Z3: at-least-once deliveries become one row per key within the watermark. NTZ times are cast first."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark([key])


def status_counts(stream: DataFrame, time: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Rows per status and event-time window, late rows within ``delay`` counted."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, window).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "status", "n")


LEASE_OUT = "id string, event string, attempts int"
LEASE_STATE = "holder string, expires bigint, attempts int"


def leases(stream: DataFrame, lease_ms: int = 300_000, max_attempts: int = 3, time: str = "ts") -> DataFrame:
    """One lease per item over a stream of (id, worker, action in claim/heartbeat/finish, ts).

    A claim is granted when no lease runs, else refused; a heartbeat of the holder extends it; event time beyond
    the lease requeues the item, or parks it after ``max_attempts``. State is one row per live item.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, expires, attempts = state.get if state.exists else (None, 0, 0)
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((key[0], "parked" if attempts >= max_attempts else "requeued", attempts))
            holder, expires = None, 0
            if attempts >= max_attempts:
                state.remove()
                yield pd.DataFrame(out, columns=["id", "event", "attempts"])
                return
        rows = [r for pdf in pdfs for r in pdf[["worker", "action", time]].itertuples(index=False, name=None)] if not state.hasTimedOut else []
        for worker, action, ts in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
            now = int(ts.timestamp() * 1000)
            if holder is not None and now > expires:
                out.append((key[0], "parked" if attempts >= max_attempts else "requeued", attempts))
                holder = None
            if action == "claim":
                if holder is None and attempts < max_attempts:
                    holder, expires, attempts = worker, now + lease_ms, attempts + 1
                    out.append((key[0], "granted", attempts))
                else:
                    out.append((key[0], "refused", attempts))
            elif holder == worker:
                if action == "heartbeat":
                    expires = now + lease_ms
                else:
                    out.append((key[0], "finished", attempts))
                    holder, expires = None, 0
            else:
                out.append((key[0], "claim_lost", attempts))
        state.update((holder, expires, attempts))
        if holder is not None:
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "event", "attempts"])

    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, "10 minutes")
    return timed.groupBy("id").applyInPandasWithState(step, LEASE_OUT, LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def append_once(target: str):
    """Z3: a foreachBatch sink that writes every epoch to a folder of its own, so a replayed epoch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return write


def drain(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Everything there is now, then stop (``availableNow``)."""
    stream.writeStream.foreachBatch(append_once(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
