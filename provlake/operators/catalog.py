"""Catalog lookups: pipelines, stages, executions, artifacts and their properties (FLT, JON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_text, property_map, property_pivot
from ..schema import INPUT, NOT_LINEAGE, OUTPUT
from ..store import MetadataStore


def pipelines(store: MetadataStore, name: str | None = None) -> DataFrame:
    """FLT01."""
    return store.pipelines if name is None else store.pipelines.where(F.col("name") == name)


def pipeline(store: MetadataStore, name: str) -> DataFrame:
    """FLT02: the pipeline of that name with the smallest id, or no row."""
    return pipelines(store, name).orderBy("id").limit(1)


def pipeline_names(store: MetadataStore) -> DataFrame:
    """FLT03."""
    return store.pipelines.select("name")


def pipeline_id(store: MetadataStore, name: str) -> DataFrame:
    """FLT04: one row; -1 if there is none of that name."""
    return pipelines(store, name).agg(F.coalesce(F.min("id"), F.lit(-1)).alias("id"))


def stages(store: MetadataStore, pipeline_id: int) -> DataFrame:
    """FLT05."""
    return store.stages.where(F.col("pipeline_id") == pipeline_id)


def stages_of(store: MetadataStore, name: str) -> DataFrame:
    """The stages of the pipeline of that name."""
    mine = pipelines(store, name).select(F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline"))
    return store.stages.join(mine, "pipeline_id")


def stage_names(store: MetadataStore, name: str) -> DataFrame:
    """FLT06."""
    return stages_of(store, name).select("name")


def executions_in(store: MetadataStore, context: DataFrame) -> DataFrame:
    """The executions associated with the contexts (context_id), each once (JON02, JON03)."""
    ids = store.association.join(context.select("context_id"), "context_id", "left_semi").select(F.col("execution_id").alias("id"))
    return store.execution.join(ids, "id", "left_semi")


def executions(store: MetadataStore, stage_id: int, execution_id: int | None = None) -> DataFrame:
    """FLT07."""
    rows = store.association.where(F.col("context_id") == stage_id).select(F.col("execution_id").alias("id")).distinct()
    found = store.execution.join(rows, "id", "left_semi")
    return found if execution_id is None else found.where(F.col("id") == execution_id)


def _stage_ids(store: MetadataStore, stage: str) -> DataFrame:
    return store.stages.where(F.col("name") == stage).select(F.col("id").alias("context_id")).distinct()


def raw_executions_of_stage(store: MetadataStore, stage: str) -> DataFrame:
    """FLT08: of the first stage of that name only."""
    return executions_in(store, _stage_ids(store, stage).orderBy("context_id").limit(1))


def _with_properties(entities: DataFrame, props: DataFrame, key: str) -> DataFrame:
    """Entities with a map of their properties (JON07); empty where there are none.

    Maps are far larger than the files that they come of, from which Spark would take them for small enough to broadcast.
    """
    ids = entities.select(F.col("id").alias(key))
    found = property_map(props.join(ids.hint("merge"), key, "left_semi"), key).withColumnRenamed(key, "id")
    return entities.join(found.hint("merge"), "id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def executions_of_stage(store: MetadataStore, stage: str) -> DataFrame:
    """FLT09: of all stages of that name, with properties."""
    return _with_properties(executions_in(store, _stage_ids(store, stage)), store.executionproperty, "execution_id")


def executions_of_pipeline(store: MetadataStore, name: str) -> DataFrame:
    """FLT10, with properties."""
    contexts = stages_of(store, name).select(F.col("id").alias("context_id"))
    return _with_properties(executions_in(store, contexts), store.executionproperty, "execution_id")


def executions_by_ids(store: MetadataStore, ids: DataFrame) -> DataFrame:
    """FLT11: ids has a column id."""
    return _with_properties(store.execution.join(ids.select("id").hint("merge"), "id", "left_semi"), store.executionproperty, "execution_id")


def short_executions(store: MetadataStore, ids: DataFrame) -> DataFrame:
    """FLT12: id, Execution_type_name and Execution_uuid, without repetition (AGG06)."""
    props = store.executionproperty.join(ids.select(F.col("id").alias("execution_id")), "execution_id", "left_semi")
    return property_pivot(props, "execution_id", ["Execution_type_name", "Execution_uuid"]).withColumnRenamed("execution_id", "id").dropDuplicates()


def _has_uuid(column: str, uuid: str) -> Column:
    """ARR01: whether a comma list has this uuid."""
    return F.array_contains(F.split(column, ","), uuid)


def executions_by_stage(store: MetadataStore, stage_id: int, uuid: str | None = None) -> DataFrame:
    """FLT13: a stage's executions, or those of its executions whose uuid list has this one."""
    rows = executions(store, stage_id)
    if uuid is None:
        return rows
    uuids = store.executionproperty.where((F.col("name") == "Execution_uuid") & _has_uuid("string_value", uuid))
    return rows.join(uuids.select(F.col("execution_id").alias("id")), "id", "left_semi")


def executions_by_uuid(store: MetadataStore, pipeline: str, uuid: str) -> DataFrame:
    """FLT26: a pipeline's executions whose uuid list has this one, with properties."""
    return executions_of_pipeline(store, pipeline).where(F.array_contains(F.split(F.col("properties")["Execution_uuid"], ","), uuid))


def executions_by_uuid_prefix(store: MetadataStore, pipeline: str, four: str) -> DataFrame:
    """FLT35: id and uuid of a pipeline's executions whose uuid begins with these four characters."""
    rows = execution_ids(store, pipeline)
    return rows.where(F.substring("Execution_uuid", 1, 4) == four).select("id", "Execution_uuid")


def execution_ids(store: MetadataStore, pipeline: str | None = None) -> DataFrame:
    """FLT34: id, Context_Type, Execution_uuid and pipeline of the executions of one or of all pipelines."""
    mine = pipelines(store, pipeline).select(F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline"))
    links = store.stages.select(F.col("id").alias("context_id"), "pipeline_id").join(mine, "pipeline_id")
    rows = store.association.join(links, "context_id").select(F.col("execution_id").alias("id"), "context_id", "pipeline")
    props = store.executionproperty
    if pipeline is not None:
        props = props.join(rows.select(F.col("id").alias("execution_id")), "execution_id", "left_semi")
    props = property_pivot(props, "execution_id", ["Context_Type", "Execution_uuid"]).withColumnRenamed("execution_id", "id")
    return rows.join(props, "id", "left").select("id", "Context_Type", "Execution_uuid", F.col("context_id").alias("Context_ID"), "pipeline")


def with_type(store: MetadataStore, entities: DataFrame) -> DataFrame:
    """Entities with the name of their type (JON06)."""
    return entities.join(store.type.select(F.col("id").alias("type_id"), F.col("name").alias("type")), "type_id")


def artifact(store: MetadataStore, name: str) -> DataFrame:
    """FLT14, FLT15: the artifact of that name, stripped, with the smallest id."""
    return with_type(store, store.artifact.where(F.col("name") == name.strip()).orderBy("id").limit(1))


def artifact_names(store: MetadataStore) -> DataFrame:
    """FLT16."""
    return store.artifact.select("name")


def artifacts_by_ids(store: MetadataStore, ids: DataFrame) -> DataFrame:
    """FLT17, with type and properties."""
    rows = store.artifact.join(ids.select("id").hint("merge"), "id", "left_semi")
    return _with_properties(with_type(store, rows), store.artifactproperty, "artifact_id")


def artifact_types(store: MetadataStore, environment: bool = True) -> DataFrame:
    """FLT18, and FLT19 without Environment: names of the types that artifacts have."""
    rows = store.type.join(store.artifact.select(F.col("type_id").alias("id")), "id", "left_semi").select("name").distinct()
    return rows if environment else rows.where(F.col("name") != "Environment")


def artifacts_of_pipeline(store: MetadataStore, name: str, distinct: bool = True) -> DataFrame:
    """FLT20: by attribution to its stages; an artifact of several stages comes once, or once a stage."""
    contexts = stages_of(store, name).select(F.col("id").alias("context_id"))
    links = store.attribution.join(contexts, "context_id").select(F.col("artifact_id").alias("id"))
    return with_type(store, store.artifact.join(links.distinct() if distinct else links, "id"))


def entity_frame(entities: DataFrame, props: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """FLT21: entities with one text column for each property name; without names, one job finds them first."""
    names = sorted(r[0] for r in props.select("name").distinct().collect()) if names is None else names
    taken = {n: f"custom_properties_{n}" if n in entities.columns else n for n in names}
    wide = property_pivot(props, key, names)
    return entities.join(wide.select(F.col(key).alias("id"), *(F.col(n).alias(taken[n]) for n in names)).hint("merge"), "id", "left")


def node_attributes(entities: DataFrame, columns: list[str]) -> DataFrame:
    """FLT22: id and a JSON object of those columns that aren't null or empty."""
    kept = [F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in columns]
    return entities.select("id", F.to_json(F.struct(*kept)).alias("attributes"))


def lineage_artifacts(store: MetadataStore) -> DataFrame:
    """FLT23: artifacts of types that lineage follows."""
    return with_type(store, store.artifact).where(~F.col("type").isin(*NOT_LINEAGE))


def name_matches(name: str, wanted: str) -> Column:
    """FLT24: by path, file name, path:hash or file name:hash."""
    path = F.substring_index(F.col(name), ":", 1)
    last = lambda c: F.substring_index(c, "/", -1)
    wanted = wanted.strip()
    return (path == wanted) | (last(path) == wanted) | (F.col(name) == wanted) | (last(F.col(name)) == wanted)


def search_artifacts(store: MetadataStore, wanted: str) -> DataFrame:
    """FLT24: ids of the artifacts whose name matches."""
    return store.artifact.where(name_matches("name", wanted)).select("id", "name")


def search_artifact(store: MetadataStore, wanted: str) -> DataFrame:
    """FLT25: the first of them."""
    return search_artifacts(store, wanted).orderBy("id").limit(1)


def complete_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """FLT27: the named columns first, then of the others those without nulls; one pass counts all nulls."""
    others = [c for c in df.columns if c not in first]
    nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in others)).first() if others else None
    return df.select(*first, *(c for c in others if not nulls[c]))


def artifacts_of_executions(store: MetadataStore, ids: DataFrame) -> DataFrame:
    """JON14: the distinct artifacts that the executions (id) touch."""
    touched = store.event.join(ids.select(F.col("id").alias("execution_id")), "execution_id", "left_semi")
    return with_type(store, store.artifact.join(touched.select(F.col("artifact_id").alias("id")), "id", "left_semi"))


def artifacts_of_execution(store: MetadataStore, execution_id: int) -> DataFrame:
    """JON11: an execution's artifacts with their direction; what isn't INPUT counts as OUTPUT."""
    events = store.event.where(F.col("execution_id") == execution_id).select(F.col("artifact_id").alias("id"), F.when(F.col("type") == INPUT, "INPUT").otherwise("OUTPUT").alias("event"))
    return with_type(store, store.artifact.join(events, "id"))


def executions_of_artifacts(store: MetadataStore, artifacts: DataFrame) -> DataFrame:
    """JON12, JON13: for each artifact (id) its executions: direction, stage (the first context) and pipeline (its first parent)."""
    events = store.event.join(artifacts.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi")
    stage = store.association.join(events.select("execution_id"), "execution_id", "left_semi").groupBy("execution_id").agg(F.min("context_id").alias("context_id"))
    parent = store.parentcontext.groupBy("context_id").agg(F.min("parent_context_id").alias("pipeline_id"))
    names = store.context.select(F.col("id"), F.col("name"))
    rows = events.join(stage, "execution_id").join(parent, "context_id")
    rows = rows.join(names.select(F.col("id").alias("context_id"), F.col("name").alias("stage")), "context_id")
    rows = rows.join(names.select(F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline")), "pipeline_id")
    return rows.select("artifact_id", "execution_id", F.when(F.col("type") == INPUT, "INPUT").otherwise("OUTPUT").alias("event"), "stage", "pipeline")


def executions_of_artifact(store: MetadataStore, name: str) -> DataFrame:
    """JON12 by name."""
    return executions_of_artifacts(store, artifact(store, name))


def artifacts_by_type(store: MetadataStore) -> DataFrame:
    """AGG08: (type, id, name) of all artifacts, each type together and in the order of its ids: a sort by range, so no task holds a type."""
    return with_type(store, store.artifact).select("type", "id", "name").orderBy("type", "id")


def pipelines_of_artifacts(store: MetadataStore) -> DataFrame:
    """AGG16: for each artifact the distinct names of its stages, sorted and joined."""
    names = store.attribution.join(store.context.select(F.col("id").alias("context_id"), "name"), "context_id")
    return names.groupBy("artifact_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("contexts"))


def exploded_uuids(store: MetadataStore) -> DataFrame:
    """execution_id and each of its uuids."""
    uuids = store.executionproperty.where(F.col("name") == "Execution_uuid")
    return uuids.select("execution_id", F.explode(F.split("string_value", ",")).alias("uuid"))


def latest_by_command(store: MetadataStore, name: str = "Execution") -> DataFrame:
    """AGG09: for each command the execution with the largest id."""
    commands = store.executionproperty.where(F.col("name") == name).select("execution_id", as_text().alias("command"))
    return commands.groupBy("command").agg(F.max("execution_id").alias("execution_id"))


def reusable_executions(store: MetadataStore, commands: DataFrame, name: str = "Execution") -> DataFrame:
    """JON18: lock-file commands (command) with the latest execution that ran the same, null where none did."""
    return commands.join(latest_by_command(store, name), "command", "left")


def pull_plan(store: MetadataStore) -> DataFrame:
    """SNK08: for each artifact name but labels the url logged last."""
    urls = store.artifactproperty.where(F.col("name") == "url").select(F.col("artifact_id").alias("id"), F.col("string_value").alias("url"))
    rows = with_type(store, store.artifact).where(F.col("type") != "Label").join(urls, "id")
    return rows.groupBy("name").agg(F.max_by("url", "id").alias("url"))


def push_plan(store: MetadataStore) -> DataFrame:
    """SNK07: the distinct .dvc files of all artifacts but metrics."""
    rows = with_type(store, store.artifact).where(F.col("type") != "Metrics")
    return rows.select(F.concat(F.substring_index("name", ":", 1), F.lit(".dvc")).alias("file")).distinct()


def label_links(props: DataFrame) -> DataFrame:
    """AGG07: the distinct labels in comma lists, each split at its colon."""
    labels = props.where((F.col("name") == "labels") & F.col("string_value").isNotNull()).select(F.explode(F.split("string_value", ",")).alias("label")).distinct()
    return labels.select(F.substring_index("label", ":", 1).alias("name"), F.when(F.instr("label", ":") > 0, F.expr("substring(label, instr(label, ':') + 1)")).alias("hash"))


def events_by_direction(store: MetadataStore) -> DataFrame:
    """Numbers of inputs and outputs of each execution, with nothing but a partial sum leaving a task."""
    return store.event.groupBy("execution_id").agg(F.count_if(F.col("type") == INPUT).alias("inputs"), F.count_if(F.col("type") == OUTPUT).alias("outputs"))
