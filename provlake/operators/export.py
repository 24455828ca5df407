"""The nested payload: pipelines with stages, executions, events and artifacts (SNK01, STM01, MRG10-12).

It travels as one row, and one JSON line, for each execution, with its pipeline and stage beside it, so no row grows with a
pipeline's history. payload() nests these rows in one document for each pipeline, as a client of one small pipeline reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_text
from ..store import MetadataStore
from .catalog import pipelines, with_type

PAYLOAD = """Pipeline array<struct<id:bigint,name:string,last_update_time_since_epoch:bigint,stages:array<struct<id:bigint,name:string,last_update_time_since_epoch:bigint,
    executions:array<struct<id:bigint,name:string,type:string,last_update_time_since_epoch:bigint,properties:map<string,string>,custom_properties:map<string,string>,
        events:array<struct<type:int,artifact:struct<id:bigint,name:string,type:string,uri:string,last_update_time_since_epoch:bigint,properties:map<string,string>,custom_properties:map<string,string>>>>>>>>>>"""


def property_maps(props: DataFrame, key: str) -> DataFrame:
    """properties and custom_properties of each entity; a custom property named type becomes user_type (MAP01)."""
    entry = lambda name: F.struct(name.alias("key"), as_text().alias("value"))
    user = F.when(F.col("name") == "type", F.lit("user_type")).otherwise(F.col("name"))
    of = lambda cond, name: F.map_from_entries(F.array_sort(F.collect_set(F.when(cond, entry(name)))))
    return props.groupBy(F.col(key).alias("id")).agg(of(~F.col("is_custom_property"), F.col("name")).alias("properties"), of(F.col("is_custom_property"), user).alias("custom_properties"))


def _chosen(store: MetadataStore, since: int | None, uuid: str | None, among: DataFrame | None) -> DataFrame:
    """Executions updated after `since`, with this uuid, or among these (id), where given."""
    runs = store.execution if not since else store.execution.where(F.col("last_update_time_since_epoch") > since)
    if uuid is not None:
        has = store.executionproperty.where((F.col("name") == "Execution_uuid") & F.array_contains(F.split("string_value", ","), uuid))
        runs = runs.join(has.select(F.col("execution_id").alias("id")), "id", "left_semi")
    return runs if among is None else runs.join(among.select("id"), "id", "left_semi")


def executions_payload(store: MetadataStore, since: int | None = None, uuid: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """One row for each execution with its nested events: only those updated after `since`, with this uuid, or among these (id), where given.

    The filters come first, so events and properties are joined for the executions that are left. Property maps and what
    holds them are never broadcast: Spark takes their size from files that don't tell how many properties they make.
    """
    runs = _chosen(store, since, uuid, among)
    ids = runs.select(F.col("id").alias("execution_id"))
    events = store.event.join(ids, "execution_id", "left_semi")
    used = events.select(F.col("artifact_id").alias("id")).distinct()
    arts = with_type(store, store.artifact.join(used, "id", "left_semi")).join(property_maps(store.artifactproperty, "artifact_id").hint("merge"), "id", "left")
    one = F.struct("id", "name", "type", "uri", "last_update_time_since_epoch", "properties", "custom_properties")
    events = events.select("execution_id", F.col("artifact_id"), F.col("type").alias("direction")).join(arts.select(F.col("id").alias("artifact_id"), one.alias("artifact")).hint("merge"), "artifact_id")
    nested = events.groupBy(F.col("execution_id").alias("id")).agg(F.collect_list(F.struct("artifact_id", F.col("direction").alias("type"), "artifact")).alias("found"))
    nested = nested.select("id", F.transform(F.array_sort("found", lambda a, b: F.when(a["artifact_id"] < b["artifact_id"], -1).when(a["artifact_id"] > b["artifact_id"], 1).otherwise(a["type"] - b["type"])), lambda x: F.struct(x["type"].alias("type"), x["artifact"].alias("artifact"))).alias("events"))
    props = property_maps(store.executionproperty.join(ids, "execution_id", "left_semi"), "execution_id")
    return with_type(store, runs).join(props.hint("merge"), "id", "left").join(nested.hint("merge"), "id", "left")


def payload_rows(store: MetadataStore, pipeline: str | None = None, since: int | None = None, uuid: str | None = None) -> DataFrame:
    """SNK01, STM01, MRG11, MRG12: one row for each execution of a stage: pipeline and stage (id, name, last_update_time_since_epoch), and execution, nested.

    since 0 or none: everything. A stage or pipeline without executions has a row without execution in a full export, and
    in an incremental one if it was updated itself (MRG10).

    Executions get pipeline and stage while they are ids, and meet their nested events by id: a join of nested rows by
    stage would bring all of a stage's to one task.
    """
    head = lambda name: F.struct("id", "name", "last_update_time_since_epoch").alias(name)
    tops = pipelines(store, pipeline)
    stages = store.stages.select(F.col("id").alias("context_id"), "pipeline_id", head("stage")).join(tops.select(F.col("id").alias("pipeline_id"), head("pipeline")), "pipeline_id")
    run = F.struct("id", "name", "type", "last_update_time_since_epoch", "properties", "custom_properties", "events").alias("execution")
    links = store.association.select("context_id", F.col("execution_id").alias("id")).distinct()
    among = links.join(stages.select("context_id"), "context_id", "left_semi") if pipeline is not None else None
    found = links.join(stages, "context_id").join(executions_payload(store, since, uuid, among).hint("merge"), "id").select("pipeline", "stage", run)
    used = links.join(_chosen(store, since, uuid, among).select("id"), "id", "left_semi").select("context_id").distinct()
    rows = found.unionByName(stages.join(used, "context_id", "left_anti").select("pipeline", "stage"), allowMissingColumns=True)
    bare = tops.join(store.stages.select(F.col("pipeline_id").alias("id")), "id", "left_anti").select(head("pipeline"))
    rows = rows.unionByName(bare, allowMissingColumns=True)
    if not since and uuid is None:
        return rows
    newer = lambda c: F.coalesce(F.col(f"{c}.last_update_time_since_epoch") > since, F.lit(False)) if since else F.lit(False)
    return rows.where(F.col("execution").isNotNull() | newer("stage") | (F.col("stage").isNull() & newer("pipeline")))


def pull(store: MetadataStore, pipeline: str | None = None, uuid: str | None = None, since: int | None = None) -> tuple[DataFrame | None, str]:
    """MRG11: what a client asks for, and the status: success, pipeline_not_exist (no rows), or no_exec_uuid (no rows)."""
    if pipeline is not None and pipelines(store, pipeline).isEmpty():
        return None, "pipeline_not_exist"
    rows = payload_rows(store, pipeline, since, uuid)
    if uuid is not None and rows.where("execution is not null").isEmpty():
        return None, "no_exec_uuid"
    return rows, "success"


def rows_json(rows: DataFrame) -> DataFrame:
    """JSN03, JSN04: a frame as JSON records, one in a row of column value."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


_RUN = PAYLOAD[PAYLOAD.index("executions:array<") + len("executions:array<") : -len(">>>>>")].strip()
ROWS = f"pipeline struct<id:bigint,name:string,last_update_time_since_epoch:bigint>, stage struct<id:bigint,name:string,last_update_time_since_epoch:bigint>, execution {_RUN}"


def read_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """SRC08: JSON lines of payload_rows(); what isn't JSON, or names no pipeline, is left out."""
    return text.select(F.from_json(column, ROWS).alias("d")).select("d.*").where("pipeline is not null")


def row_events(rows: DataFrame) -> DataFrame:
    """payload_rows() as one row for each event: names, execution, direction and artifact."""
    one = rows.select(F.col("pipeline.name").alias("pipeline"), F.col("stage.name").alias("stage"), F.col("execution.id").alias("execution_id"), F.explode("execution.events").alias("e"))
    return one.select("pipeline", "stage", "execution_id", *_event())


def _sorted_by_id(column: str):
    return F.array_sort(F.collect_list(column), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))


def payload(store: MetadataStore, pipeline: str | None = None, since: int | None = None, uuid: str | None = None) -> DataFrame:
    """payload_rows() as one document for each pipeline: id, name, last_update_time_since_epoch and nested stages.

    A document is one row, which is what a client of a small pipeline wants; a long history goes by payload_rows().
    """
    rows = payload_rows(store, pipeline, since, uuid)
    runs = rows.groupBy("pipeline", "stage").agg(_sorted_by_id("execution").alias("executions"))
    stage = F.when(F.col("stage").isNotNull(), F.struct("stage.*", "executions"))
    tops = runs.select("pipeline", stage.alias("stage")).groupBy("pipeline").agg(_sorted_by_id("stage").alias("stages"))
    return tops.select("pipeline.*", "stages")


def to_json(rows: DataFrame) -> DataFrame:
    """JSN03: one JSON document {"Pipeline": [...]} for each pipeline."""
    return rows.select(F.to_json(F.struct(F.array(F.struct("*")).alias("Pipeline"))).alias("value"))


def write_json(store: MetadataStore, path: str, pipeline: str | None = None) -> None:
    """SNK02: a JSON line for each execution, with its pipeline and stage."""
    rows_json(payload_rows(store, pipeline)).write.mode("overwrite").text(path)


def read_json(text: DataFrame, column: str = "value") -> DataFrame:
    """SRC08: documents as rows of pipelines, nested; a document that isn't JSON has none."""
    parsed = text.select(F.from_json(column, PAYLOAD).alias("d"))
    return parsed.select(F.explode("d.Pipeline").alias("p")).select("p.*")


def _event() -> list[Column]:
    return [F.col("e.type").alias("event_type"), *(F.col(f"e.artifact.{c}").alias(a) for c, a in (("id", "artifact_id"), ("name", "name"), ("type", "type"), ("uri", "uri")))]


def flat_events(rows: DataFrame) -> DataFrame:
    """Nested pipelines as one row for each event: names, execution, direction and artifact."""
    stages = rows.select(F.col("name").alias("pipeline"), F.explode("stages").alias("s"))
    runs = stages.select("pipeline", F.col("s.name").alias("stage"), F.explode("s.executions").alias("x"))
    return runs.select("pipeline", "stage", F.col("x.id").alias("execution_id"), F.explode("x.events").alias("e")).select("pipeline", "stage", "execution_id", *_event())


def environments(store: MetadataStore, pipeline: str) -> DataFrame:
    """FLT33, JSN05: the distinct names of the Environment artifacts in a pipeline's events, found from the few artifacts of that type."""
    kinds = with_type(store, store.artifact).where(F.col("type") == "Environment").select(F.col("id").alias("artifact_id"), "name")
    mine = store.stages.join(pipelines(store, pipeline).select(F.col("id").alias("pipeline_id")), "pipeline_id", "left_semi").select(F.col("id").alias("context_id"))
    runs = store.association.join(mine, "context_id", "left_semi").select("execution_id")
    used = store.event.join(kinds.select("artifact_id"), "artifact_id", "left_semi").join(runs, "execution_id", "left_semi").select("artifact_id")
    return kinds.join(used, "artifact_id", "left_semi").select("name").distinct()
