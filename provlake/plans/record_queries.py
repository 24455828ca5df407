"""Queries on merging two stores, and on recorded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..operators.catalog import exploded_uuids
from ..operators.writer import Recorder
from ..store import MetadataStore
from ..streaming import sync
from .registry import query, table_query


# The incoming store: the same pipelines, seen by another server, whose ids are others. A third of its executions are new,
# a third have one uuid more, a third share one uuid of two; a quarter of its artifacts are new.
def _incoming(s: MetadataStore) -> MetadataStore:
    runs, arts = F.lit(1_000_000), F.lit(5_000_000)
    text = lambda c: F.col(c).cast("string")
    one = F.col("execution_id")
    own = lambda mark: F.md5(F.concat(F.lit(mark), text("execution_id")))
    uuids = F.when(one % 3 == 0, own("new")).when(one % 3 == 1, F.concat_ws(",", own("x"), own("more"))).otherwise(F.concat_ws(",", own("a"), own("x")))
    props = s.executionproperty.withColumn("string_value", F.when(F.col("name") == "Execution_uuid", uuids).when(F.col("name") == "priority", F.lit("new")).otherwise(F.col("string_value")))
    uri = F.when(F.col("id") % 4 == 0, F.md5(F.concat(F.lit("n"), text("id")))).otherwise(F.col("uri"))
    moved = lambda df, **ids: df.withColumns({c: F.col(c) + by for c, by in ids.items()})
    tables = {
        "type": s.type, "context": s.context, "parentcontext": s.parentcontext,
        "execution": moved(s.execution, id=runs), "executionproperty": moved(props, execution_id=runs), "association": moved(s.association, execution_id=runs),
        "artifact": moved(s.artifact.withColumn("uri", uri), id=arts), "artifactproperty": moved(s.artifactproperty, artifact_id=arts), "attribution": moved(s.attribution, artifact_id=arts),
        "event": moved(s.event, artifact_id=arts, execution_id=runs),
    }
    return MetadataStore(s.spark, tables)


def _merged(s: MetadataStore) -> MetadataStore:
    return merge.merge_stores(s, _incoming(s), stamp=True, kinds=merge.MERGED_TYPES)


_RUN_IDS = """, fresh AS (SELECT id, (SELECT max(id) FROM execution) + row_number() OVER (ORDER BY md5('new' || id)) AS new_id FROM execution WHERE id % 3 = 0 AND name = ''),
    runs AS (SELECT e.id, coalesce(f.new_id, e.id) AS new_id FROM execution e LEFT JOIN fresh f ON f.id = e.id)"""
_ART_IDS = f"""{_RUN_IDS}, first_run AS (SELECT artifact_id, coalesce(min(new_id) FILTER (e.type = 4), min(new_id)) AS run FROM event e JOIN runs r ON r.id = e.execution_id GROUP BY 1),
    inc AS (SELECT a.id, a.type_id, CASE WHEN a.id % 4 = 0 THEN md5('n' || a.id) ELSE a.uri END AS uri, a.name AS old_name, a.uri AS old_uri, run FROM artifact a LEFT JOIN first_run f ON f.artifact_id = a.id),
    named AS (SELECT id, type_id, uri, CASE WHEN type_id = 13 AND run IS NOT NULL THEN split_part(old_name, ':', 1) || ':' || uri || ':' || run ELSE old_name END AS name FROM inc),
    there AS (SELECT n.*, o.id AS old_id FROM named n LEFT JOIN artifact o ON o.type_id = n.type_id AND o.uri = n.uri AND (n.type_id <> 13 OR o.name = n.name)),
    new_arts AS (SELECT *, (SELECT max(id) FROM artifact) + row_number() OVER (ORDER BY type_id, uri, name) AS new_id FROM there WHERE old_id IS NULL),
    arts AS (SELECT id, old_id AS new_id FROM there WHERE old_id IS NOT NULL UNION ALL SELECT id, new_id FROM new_arts)"""


@query("mrg01_merged_executions", f"""{_RUN_IDS}, u AS (SELECT execution_id AS id, unnest(string_split(string_value, ',')) AS uuid FROM executionproperty WHERE name = 'Execution_uuid'
      UNION SELECT r.new_id, unnest(CASE r.id % 3 WHEN 0 THEN [md5('new' || r.id)] WHEN 1 THEN [md5('x' || r.id), md5('more' || r.id)] ELSE [md5('a' || r.id), md5('x' || r.id)] END) FROM runs r),
    names AS (SELECT id, name FROM execution UNION ALL SELECT new_id, '' FROM fresh)
    SELECT n.id, n.name, string_agg(DISTINCT uuid, ',' ORDER BY uuid) AS uuids FROM names n JOIN u ON u.id = n.id GROUP BY 1, 2""")
def _(s: MetadataStore) -> DataFrame:
    return merge.execution_uuids(_merged(s))


@query("mrg02_merged_artifacts", f"{_ART_IDS} SELECT id, type_id, uri, name FROM artifact UNION ALL SELECT new_id, type_id, uri, name FROM new_arts")
def _(s: MetadataStore) -> DataFrame:
    """MRG02 to MRG05: artifacts by uri, metrics by their rewritten name."""
    return _merged(s).artifact.select("id", F.col("type_id").cast("int").alias("type_id"), "uri", "name")


@query("mrg05_merged_events", f"{_ART_IDS} SELECT artifact_id, execution_id, type FROM event UNION SELECT a.new_id, r.new_id, e.type FROM event e JOIN arts a ON a.id = e.artifact_id JOIN runs r ON r.id = e.execution_id")
def _(s: MetadataStore) -> DataFrame:
    return _merged(s).event.select("artifact_id", "execution_id", "type")


@query("mrg07_merged_properties", f"""{_RUN_IDS}, every AS (SELECT id FROM execution UNION ALL SELECT new_id FROM fresh)
    SELECT v.id, CASE WHEN v.id IN (SELECT new_id FROM runs) THEN 'new' ELSE p.string_value END AS priority, 9 AS n FROM every v LEFT JOIN executionproperty p ON p.execution_id = v.id AND p.name = 'priority'""")
def _(s: MetadataStore) -> DataFrame:
    """The new side's values win, and what both have stays one property."""
    props = _merged(s).executionproperty
    return props.groupBy(F.col("execution_id").alias("id")).agg(F.max(F.when(F.col("name") == "priority", F.col("string_value"))).alias("priority"), F.count("*").alias("n"))


@query("mrg08_update", f"""{_RUN_IDS} SELECT 'success' AS status, (SELECT count(*) FROM execution) + (SELECT count(*) FROM fresh) AS executions
    UNION ALL SELECT 'exists', (SELECT count(*) FROM execution WHERE name = '') UNION ALL SELECT 'invalid_json_payload', (SELECT count(*) FROM execution)""")
def _(s: MetadataStore) -> DataFrame:
    """MRG08, MRG09: only new executions are merged; a store without anything new, and a payload that can't be read, change nothing."""
    plain = MetadataStore(s.spark, {**s.tables, "execution": s.execution.where("name = ''")})
    rows = [merge.update(s, _incoming(s)), merge.update(plain, plain), merge.update(s, None)]
    parts = [m.execution.agg(F.lit(status).alias("status"), F.count("*").alias("executions")) for m, status in rows]
    return parts[0].union(parts[1]).union(parts[2])


@query("stm03_synced_executions", "SELECT id FROM execution WHERE last_update_time_since_epoch > (SELECT max(last_update_time_since_epoch) - 8640000000 FROM execution)")
def _(s: MetadataStore) -> DataFrame:
    """What an incremental sync brings to an empty store, under the source's ids."""
    since = s.execution.agg(F.max("last_update_time_since_epoch")).first()[0] - 8640000000
    target, status, _ = sync.sync_once(lambda: s, MetadataStore(s.spark), since, since + 1)
    assert status == "success"
    return exploded_uuids(target).select("uuid").join(exploded_uuids(s), "uuid").select(F.col("execution_id").alias("id")).distinct()


# Recorded runs: one for each nation, in the stage of its region.
def _recorded(spark: SparkSession, sf_dir: str) -> MetadataStore:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
    r = Recorder("P", now=1000)
    for n in rows:
        k = n.n_nationkey
        r.create_execution(f"S{n.n_regionkey}", f"run {k}", uuid=f"u{k}", properties={"k": k, "even": k % 2 == 0, "half": k / 2})
        r.log_dataset(f"in/{n.n_regionkey}", f"m{n.n_regionkey}", "input", url=f"/store/{k}", last=k)
        r.log_model(f"out/{k}", f"o{k}", "output", framework="f")
        r.log_label(f"labels/{k % 3}", f"l{k % 3}", dataset_md5=f"m{n.n_regionkey}")
        r.log_python_env("env", "e")
        r.log_slice(f"slice/{k}", f"s{k}", rows=k)
        r.update_execution({"k": k + 100})
        r.finalize(f"c{k}")
    r.update_context("S0", {"team": "zero"})
    return r.commit(MetadataStore(spark))


def _recorded_query(name: str, sql: str):
    def register(f):
        return table_query(name, sql)(lambda spark, sf_dir: f(_recorded(spark, sf_dir)))

    return register


def _named(s: MetadataStore) -> DataFrame:
    """(execution_id, uuid) of the recorded runs."""
    return s.executionproperty.where("name = 'Execution_uuid'").select("execution_id", F.col("string_value").alias("uuid"))


@_recorded_query("wrt03_recorded_contexts", "SELECT DISTINCT 'P/S' || n_regionkey AS stage, 'P' AS pipeline FROM nation")
def _(s: MetadataStore) -> DataFrame:
    """WRT02, WRT03, WRT08: each stage once, below its pipeline."""
    return s.stages.join(s.pipelines.select(F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline")), "pipeline_id").select(F.col("name").alias("stage"), "pipeline")


_NAMES = "CASE t WHEN 'Dataset' THEN 'in/' || n_regionkey || ':m' || n_regionkey WHEN 'Label' THEN 'labels/' || n_nationkey % 3 || ':l' || n_nationkey % 3 WHEN 'Environment' THEN 'env:e' WHEN 'Dataslice' THEN 'slice/' || n_nationkey || ':s' || n_nationkey ELSE 'out/' || n_nationkey || ':o' || n_nationkey || ':' || n_nationkey + 1 END"


@_recorded_query("wrt10_recorded_events", f"SELECT 'u' || n_nationkey AS uuid, t AS type, {_NAMES} AS name, CASE WHEN t IN ('Model', 'Dataslice') THEN 4 ELSE 3 END AS event FROM nation, (VALUES ('Dataset'), ('Model'), ('Label'), ('Environment'), ('Dataslice')) AS v(t)")
def _(s: MetadataStore) -> DataFrame:
    """WRT05, WRT07, WRT10, WRT13: each run's artifacts, shared ones once, with their direction."""
    kinds = s.type.select(F.col("id").alias("type_id"), F.col("name").alias("type"))
    arts = s.artifact.join(kinds, "type_id").select(F.col("id").alias("artifact_id"), "type", "name")
    return s.event.select("artifact_id", "execution_id", F.col("type").alias("event")).join(arts, "artifact_id").join(_named(s), "execution_id").select("uuid", "type", "name", "event")


@_recorded_query("wrt09_recorded_properties", "SELECT 'u' || n_nationkey AS uuid, n_nationkey + 100 AS k, n_nationkey % 2 = 0 AS even, n_nationkey / 2 AS half, 'c' || n_nationkey AS last_commit, CASE n_regionkey WHEN 0 THEN 'zero' END AS team FROM nation")
def _(s: MetadataStore) -> DataFrame:
    """WRT08, WRT09, WRT14: typed properties, of which the last value stays."""
    of = lambda name, kind: F.max(F.when(F.col("name") == name, F.col(f"{kind}_value")))
    rows = s.executionproperty.groupBy("execution_id").agg(of("Execution_uuid", "string").alias("uuid"), of("k", "int").alias("k"), of("even", "bool").alias("even"), of("half", "double").alias("half"), of("Git_End_Commit", "string").alias("last_commit"), of("team", "string").alias("team"))
    return rows.drop("execution_id")


@_recorded_query("wrt16_recorded_artifacts", "SELECT 'm' || n_regionkey AS uri, max(n_nationkey)::BIGINT AS last, count(*) AS readers FROM nation GROUP BY n_regionkey")
def _(s: MetadataStore) -> DataFrame:
    """WRT12, WRT16: what several runs log under one hash is one artifact, with the properties of the last."""
    last: Column = F.max(F.when(F.col("name") == "last", F.col("int_value")))
    props = s.artifactproperty.groupBy(F.col("artifact_id").alias("id")).agg(last.alias("last"))
    readers = s.event.groupBy(F.col("artifact_id").alias("id")).agg(F.count("*").alias("readers"))
    return s.artifact.where("uri like 'm%'").join(props, "id").join(readers, "id").select("uri", "last", "readers")


@table_query("wrt04_reused_executions", "SELECT 'named' AS name, 'a,b,c' AS uuids, 3 AS events UNION ALL SELECT '', 'd', 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WRT04, MRG01: a named execution is taken up again by later runs, one without name isn't."""
    s = MetadataStore(spark)
    for runs in ((("a", "named", "x"), ("d", "", "x")), (("b", "named", "y"), ("c", "named", "z"))):
        r = Recorder("P", now=1)
        for uuid, name, artifact in runs:
            r.create_execution("S", uuid=uuid, name=name)
            r.log_dataset(artifact, artifact, "input")
        s = r.commit(s)
    events = s.event.groupBy(F.col("execution_id").alias("id")).agg(F.count("*").cast("int").alias("events"))
    return merge.execution_uuids(s).join(events, "id").select("name", "uuids", "events")


@table_query("wrt11_recorded_metrics", "SELECT n_nationkey + 1 AS \"SequenceNumber\", n_nationkey / 4 AS loss FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WRT11: a series of steps, numbered, and logged as one artifact beside the run's metrics."""
    r = Recorder("P", now=1)
    r.create_execution("S", uuid="u")
    for n in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect():  # 25 rows
        r.log_metric("loss", loss=n.n_nationkey / 4)
    steps = r.commit_metrics(spark, "loss", "md5")
    r.log_execution_metrics("scores", auc=0.5)
    r.log_validation_output("v1")
    s = r.commit(MetadataStore(spark))
    assert sorted(x.name for x in s.type.where("type_kind = 1").collect()) == ["Metrics", "Step_Metrics", "Validation_output"] and s.event.count() == 3
    return steps
