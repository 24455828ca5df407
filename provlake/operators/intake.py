"""Payload text into a store, item by item: what can't be merged is set aside with its place and reason (MRG05, MRG06, MRG07).

The text is that of export.payload_rows(): a JSON line for each execution. A line, the execution in it and each of its events
are read by themselves, so a bad event costs neither its execution nor its neighbours, and a bad execution costs neither its
stage nor its pipeline. Every item is either in the rows that go on or in the rejects, never in both:

* line: corrupt_json (not one JSON object, or empty), no_pipeline (none, or one without id or name), no_stage (an execution
  without stage, or a stage without id or name). Nothing of such a line goes on.
* execution: corrupt_execution, execution_without_id. Its pipeline and stage go on; its events are rejected with it.
* event: corrupt_event, unknown_direction (neither input nor output), event_without_artifact, unknown_type (of the
  artifact), artifact_without_key (neither name nor uri). Its execution and its other events go on.

The first reason that holds, in this order, is given. raw is the item's text. Of one id that lines describe in several ways
the newest description holds, of equal times the largest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import stored
from ..schema import INPUT, OUTPUT, PIPELINE_TYPE, STAGE_TYPE, TABLES
from ..store import MetadataStore
from . import merge

_HEAD = "id bigint, name string, last_update_time_since_epoch bigint, __bad string"
_ARTIFACT = "struct<id:bigint,name:string,type:string,uri:string,last_update_time_since_epoch:bigint,properties:map<string,string>,custom_properties:map<string,string>>"
_RUN = "id bigint, name string, type string, last_update_time_since_epoch bigint, properties map<string,string>, custom_properties map<string,string>"

REJECTS = ("place", "item", "reason", "pipeline", "stage", "execution_id", "nth", "raw")


def _json(text: str | Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _bad(c: Column) -> Column:
    return c.isNull() | c["__bad"].isNotNull()


def _nameless(head: Column) -> Column:
    return _bad(head) | head["id"].isNull() | _blank(head["name"])


def _event_reason(e: Column, kinds: tuple[str, ...]) -> Column:
    a = e["artifact"]
    return (
        F.when(_bad(e), "corrupt_event").when(~F.coalesce(e["type"].isin(INPUT, OUTPUT), F.lit(False)), "unknown_direction").when(a["id"].isNull(), "event_without_artifact")
        .when(~F.coalesce(a["type"].isin(*kinds), F.lit(False)), "unknown_type").when(_blank(a["name"]) & _blank(a["uri"]), "artifact_without_key")
    )


def read_checked(text: DataFrame, column: str = "value", place: str | None = None, kinds: tuple[str, ...] = merge.MERGED_TYPES) -> tuple[DataFrame, DataFrame]:
    """The rows to merge, as export.read_rows() has them, and REJECTS. place: a column that says where a line stands; null without one.

    The text is parsed once and written, as both results are read from it. No row meets another, so nothing is shuffled.
    """
    at = (F.lit(None) if place is None else F.col(place)).cast("string").alias("place")
    lines = text.select(at, F.col(column).alias("raw"), _json(column, "pipeline string, stage string, execution string, __bad string").alias("line"))
    lines = lines.select("place", "raw", "line", _json("line.pipeline", _HEAD).alias("pipeline"), _json("line.stage", _HEAD).alias("stage"), _json("line.execution", f"{_RUN}, events array<string>, __bad string").alias("run"))
    whole = F.coalesce(F.col("raw").rlike(r"^\s*\{[\s\S]*\}\s*$"), F.lit(False))
    has_run, has_stage = F.col("line.execution").isNotNull(), F.col("line.stage").isNotNull()
    line_reason = F.when(~whole | _bad(F.col("line")), "corrupt_json").when(_nameless(F.col("pipeline")), "no_pipeline").when((has_run | has_stage) & _nameless(F.col("stage")), "no_stage")
    run_reason = F.when(has_run & _bad(F.col("run")), "corrupt_execution").when(has_run & F.col("run.id").isNull(), "execution_without_id")
    parsed = F.transform("run.events", lambda x, i: F.struct((i + 1).alias("nth"), x.alias("raw"), _json(x, f"type int, artifact {_ARTIFACT}, __bad string").alias("e")))
    lines = lines.withColumns({"line_reason": line_reason, "run_reason": run_reason, "events": parsed})
    lines = lines.withColumn("events", F.transform("events", lambda x: F.struct(x["nth"], x["raw"], x["e"], _event_reason(x["e"], kinds).alias("reason"))))
    lines = stored(lines)

    head = lambda c: F.when(F.col(c).isNotNull(), F.struct(*(F.col(f"{c}.{f}") for f in ("id", "name", "last_update_time_since_epoch")))).alias(c)
    good = F.transform(F.filter("events", lambda x: x["reason"].isNull()), lambda x: F.struct(x["e"]["type"].alias("type"), x["e"]["artifact"].alias("artifact")))
    run = F.struct(*(F.col(f"run.{c.split()[0]}") for c in _RUN.split(", ")), good.alias("events"))
    rows = lines.where("line_reason is null").select(head("pipeline"), head("stage"), F.when(has_run & F.col("run_reason").isNull(), run).alias("execution"))

    def rejects(df: DataFrame, item: str, reason: str, nth: Column, raw: Column) -> DataFrame:
        named = F.col("pipeline.name").alias("pipeline"), F.col("stage.name").alias("stage"), F.col("run.id").alias("execution_id")
        return df.select("place", F.lit(item).alias("item"), F.col(reason).alias("reason"), *named, nth.cast("int").alias("nth"), raw.alias("raw"))

    none = F.lit(None)
    bad_lines = rejects(lines.where("line_reason is not null"), "line", "line_reason", none, F.col("raw"))
    bad_runs = rejects(lines.where("line_reason is null and run_reason is not null"), "execution", "run_reason", none, F.col("line.execution"))
    bad_events = lines.where("line_reason is null and run_reason is null").select("place", "pipeline", "stage", "run", F.explode(F.filter("events", lambda x: x["reason"].isNotNull())).alias("x"))
    return rows, bad_lines.unionByName(bad_runs).unionByName(rejects(bad_events, "event", "x.reason", F.col("x.nth"), F.col("x.raw")))


def _described(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each id, as its newest description has it."""
    rest = [f for f in fields if f != "id"]
    best = rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("last_update_time_since_epoch", *rest)).alias("v"))
    return best.select("id", "v.*")


def _properties(rows: DataFrame, key: str) -> DataFrame:
    """Rows (id, properties, custom_properties) as properties of text; of several values of one the largest."""
    one = lambda c, custom: rows.select(F.col("id").alias(key), F.lit(custom).alias("is_custom_property"), F.explode(c).alias("name", "string_value"))
    return one("properties", False).unionByName(one("custom_properties", True)).groupBy(key, "name", "is_custom_property").agg(F.max("string_value").alias("string_value"))


def to_store(rows: DataFrame) -> MetadataStore:
    """MRG07: rows of a payload as a store of its own, with the ids of the payload, which merge_stores() maps to the other side's.

    Values are text, as the payload has them; attributions are those of an artifact's events' stages.
    """
    spark = rows.sparkSession
    heads = lambda c, kind: rows.where(F.col(c).isNotNull()).select(f"{c}.*").withColumn("type", F.lit(kind))
    contexts = _described(heads("pipeline", PIPELINE_TYPE).unionByName(heads("stage", STAGE_TYPE)), ["id", "name", "type", "last_update_time_since_epoch"]).withColumn("type_kind", F.lit(2))
    runs = rows.where("execution is not null").select(F.col("stage.id").alias("context_id"), "execution")
    events = runs.select("context_id", F.col("execution.id").alias("execution_id"), F.explode("execution.events").alias("e"))
    fields = ["id", "name", "type", "last_update_time_since_epoch"]
    executions = _described(runs.select(*(f"execution.{f}" for f in fields)), fields).withColumn("type_kind", F.lit(0))
    artifacts = _described(events.select(*(f"e.artifact.{f}" for f in [*fields, "uri"])), [*fields, "uri"]).withColumn("type_kind", F.lit(1))
    kinds = [df.select(F.col("type").alias("name"), F.col("type_kind").cast("short")).where("name is not null") for df in (contexts, executions, artifacts)]
    distinct = kinds[0].union(kinds[1]).union(kinds[2]).distinct()
    types = stored(merge.numbered(distinct, spark.createDataFrame([], TABLES["type"]), ["type_kind", "name"]))
    typed = lambda df: df.join(types.select(F.col("id").alias("type_id"), F.col("name").alias("type"), "type_kind"), ["type", "type_kind"], "left")
    link = events.select("context_id", "execution_id", F.col("e.artifact.id").alias("artifact_id"), F.col("e.type").alias("type"))
    made = {
        "type": types, "context": typed(contexts), "execution": typed(executions), "artifact": typed(artifacts),
        "parentcontext": rows.where("stage is not null").select(F.col("stage.id").alias("context_id"), F.col("pipeline.id").alias("parent_context_id")).distinct(),
        "association": runs.select("context_id", F.col("execution.id").alias("execution_id")).distinct(),
        "attribution": link.select("context_id", "artifact_id").distinct(), "event": link.select("artifact_id", "execution_id", "type").distinct(),
        "executionproperty": _properties(runs.select("execution.id", "execution.properties", "execution.custom_properties"), "execution_id"),
        "artifactproperty": _properties(events.select("e.artifact.id", "e.artifact.properties", "e.artifact.custom_properties"), "artifact_id"),
    }
    cell = lambda df, f: (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
    return MetadataStore(spark, {t: df.select(*(cell(df, f) for f in TABLES[t])) for t, df in made.items()})


def merge_text(old: MetadataStore, text: DataFrame, column: str = "value", place: str | None = None, stamp: bool = False) -> tuple[MetadataStore, DataFrame]:
    """MRG05-07: the store with what is good in a payload's text, and the rejects."""
    rows, rejects = read_checked(text, column, place)
    return merge.merge_stores(old, to_store(rows), stamp, merge.MERGED_TYPES), rejects
