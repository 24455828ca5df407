"""Incremental synchronisation and online metrics (STM)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import export, merge
from ..store import MetadataStore
from .upserts import Upserts


def changed(store: MetadataStore, since: int | None, inclusive: bool = False) -> DataFrame:
    """STM01: executions updated after `since`, strictly, or with inclusive from it on, for a merge that can take repeats."""
    if not since:
        return store.execution
    updated = F.col("last_update_time_since_epoch")
    return store.execution.where(updated >= since if inclusive else updated > since)


def sync_once(read: Callable[[], MetadataStore], target: MetadataStore, since: int | None, now: int) -> tuple[MetadataStore, str, int | None]:
    """STM02, STM03: pull, merge, and the next checkpoint: `now`, taken before the pull, on success; else the old one.

    Only executions that changed since the last checkpoint, and what they touch, enter the merge.
    """
    source = read()
    rows = changed(source, since)
    if rows.isEmpty():
        return target, "exists", since
    return merge.merge_stores(target, merge.restrict(source, rows, since) if since else source, kinds=merge.MERGED_TYPES), "success", now


def read_upserts(spark: SparkSession, target: str, schema: object) -> DataFrame:
    """The table that upsert_stream() keeps, as its newest commit has it."""
    return Upserts(spark, target, schema, [], "").rows()


def upsert_stream(spark: SparkSession, source: str, schema: object, target: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """STM03, STM06: a folder of Parquet change files into a table of newest rows by key, one batch after the other; read_upserts() reads it.

    Any number of such streams, each with a checkpoint of its own, may write one table; upserts.Upserts says how.
    """
    table = Upserts(spark, target, schema, keys, order)

    def upsert(batch: DataFrame, epoch: int) -> None:
        table.upsert(batch, checkpoint, epoch)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums in tumbling windows of event time; rows later than the watermark are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def best_so_far(metrics: DataFrame, trial: str = "trial", metric: str = "metric") -> DataFrame:
    """STM05: each trial's best metric, kept up to date on a stream in complete or update mode."""
    return metrics.groupBy(trial).agg(F.max(metric).alias("best"), F.count("*").alias("steps"))


def incremental_payload(store: MetadataStore, since: int | None) -> DataFrame:
    """STM01, MRG12: the payload of what changed, one row for each execution."""
    return export.payload_rows(store, since=since)
