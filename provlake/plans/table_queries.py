"""Selection, schedules, metrics and windows over the driver's tables."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import scratch_path
from ..functions import times, values
from ..operators import control, export, selection
from ..schema import CONTROL_TABLES
from ..sources import files
from ..streaming import sync, upserts
from .registry import table_query


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Schedules: one for each customer, by rule. 1704067200000 is 2024-01-01T00:00Z, a Monday.
_NOW = 1704067200000
_RULES = "c_custkey AS id, c_nationkey AS server_id, CASE c_custkey % 3 WHEN 0 THEN 'interval' WHEN 1 THEN 'daily' ELSE 'weekly' END AS recurrence_mode, CASE WHEN c_custkey % 2 = 0 THEN 'minutes' ELSE 'hours' END AS interval_unit, CAST(c_custkey % 50 + 1 AS INT) AS interval_value"
_SCHEDULES_SQL = f"(SELECT {_RULES}, {_NOW} + c_custkey * 5000017 AS due, c_custkey % 4 <> 0 AS active, c_custkey % 24 AS hour, c_custkey % 60 AS minute, c_custkey % 7 AS weekday FROM customer)"
_DAY = "(due - due % 86400000)"


def _schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.element_at(F.array(*map(F.lit, ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))), (k % 7 + 1).cast("int"))
    clock = F.concat(two(k % 24), F.lit(":"), two(k % 60))
    columns = {
        "id": k, "server_id": F.col("c_nationkey").cast("long"), "timezone": F.lit("UTC"), "start_time_utc": F.lit(_NOW) + k * 5000017, "next_run_time_utc": F.lit(_NOW) + k * 5000017,
        "active": k % 4 != 0, "status": F.lit("active"), "one_time": k % 10 == 9, "created_at": F.lit(_NOW).cast("long"),
        "recurrence_mode": F.element_at(F.array(F.lit("interval"), F.lit("daily"), F.lit("weekly")), (k % 3 + 1).cast("int")),
        "interval_unit": F.when(k % 2 == 0, "minutes").otherwise("hours"), "interval_value": (k % 50 + 1).cast("int"), "daily_time": clock, "weekly_day": day, "weekly_time": clock,
    }
    rows = _read(spark, sf_dir, "customer").select(*(v.alias(c) for c, v in columns.items()))
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in CONTROL_TABLES["scheduled_syncs"]))


_STEP = "interval_value * CASE WHEN interval_unit = 'minutes' THEN 60000 ELSE 3600000 END"
_CLOCK = "(hour * 3600000 + minute * 60000)"


@table_query("flt30_due_schedules", f"SELECT id FROM {_SCHEDULES_SQL} WHERE active AND due <= {_NOW + 1000000000}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.due_schedules(_schedules(spark, sf_dir), _NOW + 1000000000).select("id")


@table_query("flt31_active_schedules", f"SELECT id FROM {_SCHEDULES_SQL} WHERE active AND server_id = 7")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.active_schedules(_schedules(spark, sf_dir), 7).select("id")


_WEEKLY = f"{_DAY} + {_CLOCK} + 86400000 * CASE WHEN ahead = 0 AND {{passed}} THEN 7 ELSE ahead END"


@table_query("dat04_next_runs", f"""SELECT id, (CASE recurrence_mode WHEN 'interval' THEN due + {_STEP} WHEN 'daily' THEN {_DAY} + {_CLOCK} + CASE WHEN {_DAY} + {_CLOCK} <= due THEN 86400000 ELSE 0 END
    ELSE {_WEEKLY.format(passed=f'{_DAY} + {_CLOCK} <= due')} END)::BIGINT AS next_run
    FROM (SELECT *, (weekday - (due // 86400000 + 3) % 7 + 7) % 7 AS ahead FROM {_SCHEDULES_SQL})""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {f.name: F.col(f.name) for f in CONTROL_TABLES["scheduled_syncs"]}
    run = times.next_run(c["start_time_utc"], c["timezone"], c["recurrence_mode"], c["interval_unit"], c["interval_value"], c["daily_time"], c["weekly_day"], c["weekly_time"])
    return _schedules(spark, sf_dir).select("id", run.alias("next_run"))


_ZONES = ("Europe/Berlin", "America/New_York", "Japan", "EST", "Europe/Nowhere", None)
_ZONED = f"""(SELECT *, timezone(zone, make_timestamptz(due * 1000)) AS here FROM (SELECT *, 4 + id % 20 AS at_hour,
    CASE id % 6 {' '.join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(_ZONES[:4]))} ELSE 'UTC' END AS zone FROM {_SCHEDULES_SQL}))"""


@table_query("dat06_zoned_runs", f"""SELECT id, CASE WHEN recurrence_mode <> 'interval' THEN epoch_ms(timezone(zone, first + to_days(CASE WHEN recurrence_mode = 'daily' THEN CASE WHEN first <= here THEN 1 ELSE 0 END
      ELSE CASE WHEN ahead = 0 AND first <= here THEN 7 ELSE ahead END END))) ELSE due + {_STEP} END::BIGINT AS next_run
    FROM (SELECT *, date_trunc('day', here)::TIMESTAMP + to_hours(at_hour) + to_minutes(minute) AS first, ((weekday - isodow(here) + 8) % 7)::INT AS ahead FROM {_ZONED})""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT04, DAT06: runs in four zones with and without a slash and with summer time, in an unknown one and in none; hours that every day has."""
    c = {f.name: F.col(f.name) for f in CONTROL_TABLES["scheduled_syncs"]}
    zone = F.get(F.array(*map(F.lit, _ZONES)), (F.col("id") % 6).cast("int"))
    clock = F.concat((F.col("id") % 20 + 4).cast("string"), F.lit(":"), (F.col("id") % 60).cast("string"))
    run = times.next_run(c["start_time_utc"], zone, c["recurrence_mode"], c["interval_unit"], c["interval_value"], clock, c["weekly_day"], clock)
    return _schedules(spark, sf_dir).select("id", run.alias("next_run"))


_LATER = _NOW + 2_000_000_000


@table_query("dat05_first_runs", f"""SELECT id, (CASE recurrence_mode WHEN 'interval' THEN CASE WHEN start > {_LATER} THEN start ELSE start + (({_LATER} - start) // ({_STEP}) + 1) * {_STEP} END
    WHEN 'daily' THEN {_DAY} + {_CLOCK} + CASE WHEN {_DAY} + {_CLOCK} < due THEN 86400000 ELSE 0 END
    ELSE {_WEEKLY.format(passed=f'{_DAY} + {_CLOCK} < due')} END)::BIGINT AS first_run
    FROM (SELECT *, (weekday - (due // 86400000 + 3) % 7 + 7) % 7 AS ahead FROM (SELECT * EXCLUDE (due), due AS start, greatest(due, {_LATER}) AS due FROM {_SCHEDULES_SQL}))""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.with_first_run(_schedules(spark, sf_dir), _LATER).select("id", F.col("next_run_time_utc").alias("first_run"))


@table_query("ctl02_after_run", f"SELECT id, active AND id % 10 <> 9 AS active, CASE WHEN id % 10 = 9 THEN 'completed' ELSE 'active' END AS status FROM {_SCHEDULES_SQL}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.with_next_run(_schedules(spark, sf_dir)).select("id", "active", "status")


_LOGS = "(SELECT o_orderkey AS id, o_custkey AS schedule_id, epoch_us(o_orderdate) // 1000 AS run_time_utc FROM orders)"


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))")
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("schedule_id"), ms.alias("run_time_utc"))


@table_query("srt07_schedule_logs", f"SELECT * FROM {_LOGS} WHERE schedule_id = 7 ORDER BY run_time_utc DESC, id DESC LIMIT 50")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.schedule_logs(_logs(spark, sf_dir), 7)


@table_query("jon10_server_logs", f"SELECT l.* FROM {_LOGS} l JOIN customer ON c_custkey = schedule_id WHERE c_nationkey = 7 ORDER BY run_time_utc DESC, id DESC LIMIT 100")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.server_logs(_logs(spark, sf_dir), _schedules(spark, sf_dir), 7)


def _servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("server_name"), F.concat(F.lit("host-"), F.col("n_nationkey")).alias("host_info"), F.lit(0).cast("long").alias("last_sync_time"))


@table_query("ctl02_deactivated", f"SELECT id, active AND id <> 7 AS active, CASE WHEN id = 7 THEN 'deleted' ELSE 'active' END AS status FROM {_SCHEDULES_SQL}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.deactivate(_schedules(spark, sf_dir), 7).select("id", "active", "status")


@table_query("ctl03_manual_sync", "SELECT max(c_custkey) + 1 AS schedule_id, 3 AS server_id, false AS active, 'completed' AS status, true AS one_time, 123 AS run_time_utc, 'success' AS log_status, 'sync_now' AS sync_type FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered server's sync is logged, an unknown one's isn't."""
    logs = spark.createDataFrame([], CONTROL_TABLES["sync_logs"])
    schedules, logs = control.log_manual_sync(_schedules(spark, sf_dir), logs, _servers(spark, sf_dir), "NATION_3", "host-3", 123, "success", "done")
    schedules, logs = control.log_manual_sync(schedules, logs, _servers(spark, sf_dir), "NATION_3", "other", 124, "failure", "")
    s = schedules.select(F.col("id").alias("schedule_id"), "server_id", "active", "status", "one_time")
    return logs.join(s.withColumnRenamed("status", "state"), "schedule_id").select("schedule_id", "server_id", "active", F.col("state").alias("status"), "one_time", "run_time_utc", F.col("status").alias("log_status"), "sync_type")


@table_query("flt32_find_server", "SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_name = 'NATION_3'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.find_server(_servers(spark, sf_dir), name="NATION_3", host="host-3").select("id")


@table_query("ctl01_register", "SELECT n_nationkey::BIGINT AS id, n_name AS server_name FROM nation UNION ALL SELECT max(n_nationkey) + 1, 'NEW' FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([("NEW", "host-new", None), ("NATION_3", "other", None), ("SELF", "own", None)], "server_name string, host_info string, last_sync_time long")
    return control.register(_servers(spark, sf_dir), new, own_host="own").select("id", "server_name")


@table_query("stm02_checkpoint", "SELECT n_nationkey::BIGINT AS id, CASE n_nationkey WHEN 3 THEN 500 ELSE 0 END::BIGINT AS last_sync_time FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = control.advance_checkpoint(_servers(spark, sf_dir), 3, 500, "success")
    return control.advance_checkpoint(rows, 4, 600, "exists").select("id", "last_sync_time")


# Selection. Probabilities are made of the embeddings: squares, normalised.
_P = "(SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE / (list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS p FROM embeddings)"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding", e.alias("e"))
    return rows.withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y)))


@table_query("srt10_least_confidence", f"SELECT id, round(list_max(p), 6) AS score FROM {_P} ORDER BY list_max(p), id LIMIT 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.least_confidence(_pool(spark, sf_dir), 10).select("id", F.round("score", 6).alias("score"))


@table_query("srt10_least_margin", f"SELECT id, round(list_sort(p)[-1] - list_sort(p)[-2], 6) AS score FROM {_P} ORDER BY list_sort(p)[-1] - list_sort(p)[-2], id LIMIT 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.least_margin(_pool(spark, sf_dir), 10).select("id", F.round("score", 6).alias("score"))


@table_query("srt10_most_entropy", f"SELECT id, round(list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END)), 6) AS score FROM {_P} ORDER BY list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END)) DESC, id LIMIT 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.most_entropy(_pool(spark, sf_dir), 10).select("id", F.round("score", 6).alias("score"))


_ENT = "list_sum(list_transform({0}, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END))"


@table_query("srt11_most_disagreement", f"""SELECT id, round(score, 6) AS score FROM (SELECT id, {_ENT.format("m")} - {_ENT.format("p")} AS score
    FROM (SELECT id, p, list_transform(range(1, len(p) + 1), lambda i: (p[i] + p[len(p) + 1 - i]) / 2) AS m FROM {_P})) ORDER BY score DESC, id LIMIT 10""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = _pool(spark, sf_dir).withColumn("draws", F.array("p", F.reverse("p")))
    return selection.most_disagreement(draws, 10).select("id", F.round("score", 6).alias("score"))


@table_query("srt12_random_pick", "SELECT vec_id AS id FROM embeddings ORDER BY md5(vec_id::VARCHAR || ':7'), vec_id LIMIT 20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.random_pick(_pool(spark, sf_dir).select("id"), 20, seed=7)


@table_query("srt13_near_centroids")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.near_centroids(_pool(spark, sf_dir).select("id", "embedding"), 5)


_FAR = "SELECT id, v, d FROM {0} ORDER BY d DESC, id LIMIT 1"


@table_query("srt14_farthest_first", f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    d0 AS (SELECT v.id, v.v, min(list_distance(v.v, l.v)) AS d FROM v, v l WHERE l.id IN (0, 1) AND v.id NOT IN (0, 1) GROUP BY ALL), f1 AS ({_FAR.format("d0")}),
    d1 AS (SELECT d0.id, d0.v, least(d0.d, list_distance(d0.v, f1.v)) AS d FROM d0, f1 WHERE d0.id <> f1.id), f2 AS ({_FAR.format("d1")}),
    d2 AS (SELECT d1.id, d1.v, least(d1.d, list_distance(d1.v, f2.v)) AS d FROM d1, f2 WHERE d1.id <> f2.id), f3 AS ({_FAR.format("d2")})
    SELECT 0 AS id, 0 AS nth, NULL AS distance UNION ALL SELECT 1, 0, NULL UNION ALL SELECT id, 1, round(d, 5) FROM f1 UNION ALL SELECT id, 2, round(d, 5) FROM f2 UNION ALL SELECT id, 3, round(d, 5) FROM f3""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.farthest_first(_pool(spark, sf_dir), 3, [0, 1]).withColumn("distance", F.round("distance", 5))


@table_query("srt16_label_pool", "SELECT count(*) AS n, 25 AS labeled FROM embeddings")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.label_at_random(_pool(spark, sf_dir).select("id"), 25, seed=3).agg(F.count("*").alias("n"), F.count_if("labeled").cast("int").alias("labeled"))


_TRIALS = "(SELECT user_id AS trial, event_id AS step, value AS metric, 'model-' || event_id AS model FROM events)"


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("trial"), F.col("event_id").alias("step"), F.col("value").alias("metric"), F.concat(F.lit("model-"), "event_id").alias("model"))


@table_query("agg10_best_trials", f"SELECT trial, arg_max(model, metric) AS model, max(metric) AS best FROM {_TRIALS} GROUP BY trial")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_trials(_trials(spark, sf_dir), "metric")


@table_query("srt09_top_trials", f"SELECT trial, best, row_number() OVER (ORDER BY best DESC, trial) <= 5 AS in_top_n FROM (SELECT trial, max(metric) AS best FROM {_TRIALS} GROUP BY trial)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_trials(_trials(spark, sf_dir), "metric", n=5).drop("model")


@table_query("win03_numbered_steps", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS \"SequenceNumber\" FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.numbered_steps(_read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@table_query("stm05_best_so_far", f"SELECT trial, max(metric) AS best, count(*) AS steps FROM {_TRIALS} GROUP BY trial")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.best_so_far(_trials(spark, sf_dir))


@table_query("stm_windowed_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sync.windowed_events(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_SCORED = "(SELECT l_orderkey, l_linenumber, round(l_discount * 10, 6) AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 10, 6).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linestatus").alias("g"), (F.col("l_quantity") > 25).cast("int").alias("hat"))


@table_query("agg17_ranking_quality", f"""SELECT round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision
    FROM (SELECT p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM (SELECT score, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM {_SCORED} GROUP BY score) WINDOW w AS (ORDER BY score DESC))""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ranking_quality(_scored(spark, sf_dir), "score", "y").select(F.round("roc_auc", 6).alias("roc_auc"), F.round("average_precision", 6).alias("average_precision"))


@table_query("agg17_roc_points", f"SELECT score AS threshold, (sum(sum(y)) OVER (ORDER BY score DESC))::BIGINT AS tp, (sum(sum(1 - y)) OVER (ORDER BY score DESC))::BIGINT AS fp FROM {_SCORED} GROUP BY score")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.roc_points(_scored(spark, sf_dir), "score", "y")


@table_query("agg19_group_fairness", """SELECT g, count(*) AS n, round(avg(hat), 6) AS selection_rate, round(avg((hat = y)::INT), 6) AS accuracy, round(avg(hat) FILTER (y = 1), 6) AS tpr, round(avg(1 - hat) FILTER (y = 0), 6) AS tnr
    FROM (SELECT l_linestatus AS g, (l_quantity > 25)::INT AS hat, (l_returnflag = 'R')::INT AS y FROM lineitem) GROUP BY g""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.group_fairness(_scored(spark, sf_dir), "g", "y", "hat")
    return rows.select("g", "n", *(F.round(c, 6).alias(c) for c in ("selection_rate", "accuracy", "tpr", "tnr")))


@table_query("agg19_fairness_gaps", """SELECT round(max(s) FILTER (g = 'F') - max(s) FILTER (g = 'O'), 6) AS statistical_parity_difference, round(max(s) FILTER (g = 'F') / max(s) FILTER (g = 'O'), 6) AS disparate_impact
    FROM (SELECT l_linestatus AS g, avg((l_quantity > 25)::INT) AS s FROM lineitem GROUP BY 1)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.fairness_gaps(selection.group_fairness(_scored(spark, sf_dir), "g", "y", "hat"), "g", "O", "F")
    return rows.select(F.round("statistical_parity_difference", 6).alias("statistical_parity_difference"), F.round("disparate_impact", 6).alias("disparate_impact"))


@table_query("str16_infer_metrics", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'int' WHEN event_id % 4 = 1 THEN 'float' WHEN event_id % 4 = 2 THEN 'list' ELSE 'string' END AS kind FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 4 == 0, i).when(F.col("event_id") % 4 == 1, F.concat(i, F.lit(".5"))).when(F.col("event_id") % 4 == 2, F.concat(i, F.lit(","), i)).otherwise(F.concat(F.lit("v"), i))
    return _read(spark, sf_dir, "events").withColumn("text", text).select("event_id", values.infer_metric("text").alias("kind"))


@table_query("src14_manifest_objects", "SELECT 'part/' || p_partkey AS relpath, md5(p_partkey::VARCHAR) AS md5, substring(md5(p_partkey::VARCHAR), 1, 2) || '/' || substring(md5(p_partkey::VARCHAR), 3) AS key FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.concat(F.lit("part/"), "p_partkey").alias("relpath"), F.md5(F.col("p_partkey").cast("string")).alias("md5"))
    manifests = _read(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.collect_list(item)).alias("value"))
    return files.manifest_objects(manifests)


@table_query("src17_verify", "SELECT CASE p_partkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'different' ELSE 'missing' END AS state, count(*) AS n FROM part GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    part = _read(spark, sf_dir, "part")
    expected = part.select(k.alias("key"), F.md5(k).alias("md5"))
    content = F.when(F.col("p_partkey") % 3 == 0, k).otherwise(F.concat(k, F.lit("?")))
    found = part.where("p_partkey % 3 <> 2").select(k.alias("key"), content.cast("binary").alias("content"))
    return files.verify(found, expected).groupBy("state").agg(F.count("*").alias("n"))


@table_query("src13_union_servers", "SELECT server, count(*) AS n, count(c_acctbal) AS with_balance FROM (SELECT 'a' AS server, c_acctbal FROM customer UNION ALL SELECT 'b', NULL FROM customer WHERE c_custkey % 2 = 0) GROUP BY server")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    both = files.union_servers({"a": c.select("c_custkey", "c_acctbal"), "b": c.where("c_custkey % 2 = 0").select("c_custkey")})
    return both.groupBy("server").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("with_balance"))


@table_query("src11_parse_posts", "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label, 'order ' || o_orderkey || ' is <' || o_orderstatus || '>' AS text FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('  <row Id="'), F.col("o_orderkey"), F.lit('" Tags="&lt;x&gt;&lt;'), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("calm"), F.lit('&gt;" Title="order  '), F.col("o_orderkey"), F.lit('" Body="is&#xA; &lt;'), F.col("o_orderstatus"), F.lit('&gt; " />'))
    lines = _read(spark, sf_dir, "orders").select(line.alias("value")).union(spark.createDataFrame([("<posts>",), ("",)], "value string"))
    return files.parse_posts(lines, "urgent")


_EVENTS = "SELECT event_id AS \"SequenceNumber\", value AS loss FROM events"


@table_query("src06_step_metrics", _EVENTS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC06, SNK03: step metrics written and read back."""
    path = scratch_path(spark, "metrics")
    files.write_metrics(_read(spark, sf_dir, "events").select(F.col("value").alias("loss"), F.col("event_id").alias("SequenceNumber")), path)
    return files.read_metrics(spark, path)


@table_query("src07_data_slice", "SELECT 'part/' || p_partkey AS \"Path\", md5(p_partkey::VARCHAR) AS hash, CASE WHEN p_partkey = 7 THEN 'new' ELSE p_brand END AS brand FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC07, SNK04, SNK05: a slice written, one record changed, written anew and read back."""
    rows = _read(spark, sf_dir, "part").select(F.concat(F.lit("part/"), "p_partkey").alias("Path"), F.md5(F.col("p_partkey").cast("string")).alias("hash"), F.col("p_brand").alias("brand"))
    first, second = scratch_path(spark, "slice"), scratch_path(spark, "slice")
    files.write_slice(rows.union(rows), first)
    files.write_slice(files.update_slice(files.read_slice(spark, first), "part/7", {"brand": "new"}), second)
    return files.read_slice(spark, second)


@table_query("src10_read_tsv", "SELECT p_partkey::VARCHAR AS id, p_size AS label, p_name || ' \"x' AS text FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    _read(spark, sf_dir, "part").select(F.concat_ws("\t", "p_partkey", "p_size", F.concat("p_name", F.lit(' "x'))).alias("value")).write.text(path)
    return files.read_tsv(spark, path)


@table_query("src09_lock_stages", "SELECT 's' || n_nationkey AS stage, 'run ' || n_name AS command, side AS direction, side || '/' || n_nationkey AS path, md5(side || n_nationkey) AS md5 FROM nation, (VALUES ('deps'), ('outs')) AS v(side)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC09, SRC18."""
    rows = _read(spark, sf_dir, "nation").collect()  # 25 rows: a lock file
    item = lambda side, k: {"path": f"{side}/{k}", "md5": hashlib.md5(f"{side}{k}".encode()).hexdigest()}
    lock = {"stages": {f"s{r.n_nationkey}": {"cmd": f"run {r.n_name}", **{side: [item(side, r.n_nationkey)] for side in ("deps", "outs")}} for r in rows}}
    return files.lock_stages(spark, lock)


@table_query("src18_lineage_strings", "SELECT 's' || n_nationkey AS stage, 'run ' || n_name || ',s' || n_nationkey || ',P' AS lineage FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lock = {"stages": {f"s{r.n_nationkey}": {"cmd": f"run {r.n_name}", "outs": [{"path": "x", "md5": "y"}]} for r in _read(spark, sf_dir, "nation").collect()}}
    return files.lineage_strings(files.lock_stages(spark, lock), "P")


@table_query("src15_read_objects", "SELECT n_name AS content, count(*) AS n FROM nation GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15, SRC16: objects below nested folders, by key and content."""
    path = scratch_path(spark, "objects")
    _read(spark, sf_dir, "nation").select(F.concat(F.lit("k"), "n_nationkey").alias("k"), F.col("n_name").alias("value")).write.partitionBy("k").text(path)
    rows = files.read_objects(spark, path).where(F.col("key").like("k=%/part-%"))
    return rows.select(F.trim(F.regexp_replace(F.decode("content", "UTF-8"), "\n", "")).alias("content")).groupBy("content").agg(F.count("*").alias("n"))


@table_query("agg14_transfer_counts", "SELECT count(*) AS total, count(*) FILTER (p_partkey % 3 = 0) AS ok, count(*) FILTER (p_partkey % 3 <> 0) AS failed FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.transfer_counts(_read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, "ok").otherwise("missing").alias("state")))


@table_query("jsn04_records", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.rows_json(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@table_query("agg18_tf_idf")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    return selection.tf_idf(docs).select("p_partkey", F.round(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x), 6).alias("weight"))


_EVENT = "event_id bigint, user_id bigint, ts timestamp, value double"


@table_query("stm06_two_writers", "SELECT user_id, arg_max(event_id, (ts, event_id))::BIGINT AS event_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM06: each user's newest event, kept by two writers at once, each with two batches in which users are mixed."""
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), F.col("ts").cast("timestamp"), "value")
    table = upserts.Upserts(spark, scratch_path(spark, "newest"), _EVENT + ", at struct<ts:timestamp,event_id:bigint>", ["user_id"], "at")
    rows = rows.withColumn("at", F.struct("ts", "event_id"))

    def write(writer: int) -> None:
        for epoch in range(2):
            table.upsert(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == 2 * writer + epoch), f"writer {writer}", epoch)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, range(2)))
    return table.rows().select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
