"""Control tables: servers, schedules, logs (CTL, FLT30-32, SRT07, JON10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import first_run, next_run
from .merge import insert_absent, numbered

_RULE = ("timezone", "recurrence_mode", "interval_unit", "interval_value", "daily_time", "weekly_day", "weekly_time")


def due_schedules(schedules: DataFrame, now: int) -> DataFrame:
    """FLT30."""
    return schedules.where(F.col("active") & (F.col("next_run_time_utc") <= now))


def active_schedules(schedules: DataFrame, server_id: int | None = None) -> DataFrame:
    """FLT31."""
    rows = schedules.where("active")
    return rows if server_id is None else rows.where(F.col("server_id") == server_id)


def find_server(servers: DataFrame, server_id: int | None = None, name: str | None = None, host: str | None = None) -> DataFrame:
    """FLT32."""
    for column, value in (("id", server_id), ("server_name", name), ("host_info", host)):
        servers = servers if value is None else servers.where(F.col(column) == value)
    return servers


def register(servers: DataFrame, new: DataFrame, own_host: str = "") -> DataFrame:
    """CTL01, CTL04: servers with the new ones whose name isn't taken and whose host isn't our own."""
    return insert_absent(servers, new.where(F.col("host_info") != own_host), ["server_name"])


def advance_checkpoint(servers: DataFrame, server_id: int, pulled_at: int, status: str) -> DataFrame:
    """CTL02, STM02: last_sync_time becomes the time before the pull, on success only."""
    hit = (F.col("id") == server_id) & F.lit(status == "success")
    return servers.withColumn("last_sync_time", F.when(hit, F.lit(pulled_at)).otherwise(F.col("last_sync_time")))


def deactivate(schedules: DataFrame, schedule_id: int) -> DataFrame:
    """CTL02: a soft delete."""
    hit = F.col("id") == schedule_id
    return schedules.withColumns({"active": F.col("active") & ~hit, "status": F.when(hit, "deleted").otherwise(F.col("status"))})


def with_next_run(schedules: DataFrame) -> DataFrame:
    """DAT04: schedules after a run: a one-time schedule ends, another gets its next run."""
    c = {k: F.col(k) for k in _RULE}
    after = next_run(F.col("next_run_time_utc"), c["timezone"], c["recurrence_mode"], c["interval_unit"], c["interval_value"], c["daily_time"], c["weekly_day"], c["weekly_time"])
    once = F.col("one_time")
    return schedules.withColumns({"next_run_time_utc": F.when(once, F.col("next_run_time_utc")).otherwise(after), "active": F.col("active") & ~once, "status": F.when(once, "completed").otherwise(F.col("status"))})


def with_first_run(schedules: DataFrame, now: int) -> DataFrame:
    """DAT05: new schedules with their first run; the interval is 6 hours where none is given (API04)."""
    c = {k: F.col(k) for k in _RULE}
    first = first_run(F.col("start_time_utc"), F.lit(now), c["timezone"], c["recurrence_mode"], F.coalesce(c["interval_unit"], F.lit("hours")), F.coalesce(c["interval_value"], F.lit(6)), c["daily_time"], c["weekly_day"], c["weekly_time"])
    return schedules.withColumn("next_run_time_utc", first)


def schedule_logs(logs: DataFrame, schedule_id: int, limit: int = 50) -> DataFrame:
    """SRT07: newest first."""
    return logs.where(F.col("schedule_id") == schedule_id).orderBy(F.desc("run_time_utc"), F.desc("id")).limit(limit)


def server_logs(logs: DataFrame, schedules: DataFrame, server_id: int, limit: int = 100) -> DataFrame:
    """SRT07, JON10."""
    mine = schedules.where(F.col("server_id") == server_id).select(F.col("id").alias("schedule_id"))
    return logs.join(mine, "schedule_id").orderBy(F.desc("run_time_utc"), F.desc("id")).limit(limit)


def log_manual_sync(schedules: DataFrame, logs: DataFrame, servers: DataFrame, name: str, host: str, at: int, status: str, message: str) -> tuple[DataFrame, DataFrame]:
    """CTL03: schedules and logs after a sync by hand: a one-time schedule that is already completed, and its log; as they were for a server that isn't registered."""
    mine = find_server(servers, name=name, host=host).select(F.col("id").alias("server_id"))
    once = mine.select(
        "server_id", F.lit("UTC").alias("timezone"), F.lit(at).cast("long").alias("start_time_utc"), F.lit(at).cast("long").alias("next_run_time_utc"), F.lit(False).alias("active"),
        F.lit("completed").alias("status"), F.lit(True).alias("one_time"), F.lit(at).cast("long").alias("created_at"),
    )
    once = numbered(once, schedules, ["server_id"])
    log = once.select(F.col("id").alias("schedule_id"), F.lit(at).cast("long").alias("run_time_utc"), F.lit(status).alias("status"), F.lit(message).alias("message"), F.lit("sync_now").alias("sync_type"))
    return schedules.unionByName(once, allowMissingColumns=True), logs.unionByName(numbered(log, logs, ["schedule_id"]), allowMissingColumns=True)
