"""Paged, searchable browsing (AGG01-05, FLT28-29, SRT01-05, WIN01-02).

A page is chosen among ids and sort keys first; properties are joined to its rows only. Without a search nothing reads the
properties of a whole stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import stored
from ..functions.times import search_tokens
from ..functions.values import property_json
from ..store import MetadataStore
from . import paging
from .catalog import executions_in, with_type


@dataclass(frozen=True)
class Page:
    """SRT05: a request's page, size, order and search text. number and size must be above 0."""

    number: int = 1
    size: int = 5
    sort_column: str = "name"
    descending: bool = False
    search: str = ""

    def __post_init__(self) -> None:
        if self.number < 1 or self.size < 1:
            raise ValueError("page number and size must be above 0")

    def cut(self, rows: DataFrame, key: str, id: str, nulls_last: bool) -> DataFrame:
        """SRT03: the page of rows by key, ties by id."""
        return paging.seek(rows, key, id, (self.number - 1) * self.size, self.size, self.descending, nulls_last)


def contains(parts: list[Column], search: str) -> Column:
    """STR02, STR03: whether the joined parts, nulls left out, have the text, in any case; % and _ are wildcards."""
    return F.concat_ws("", *parts).ilike(f"%{search}%")


def pipeline_executions(store: MetadataStore, pipeline: str) -> DataFrame:
    """Executions of all contexts below the contexts of that name (JON01-03)."""
    parents = store.context.where(F.col("name") == pipeline).select(F.col("id").alias("parent_context_id"))
    return executions_in(store, store.parentcontext.join(parents, "parent_context_id", "left_semi"))


def stages(store: MetadataStore, pipeline: str) -> DataFrame:
    """SRT06, AGG04: stage_name of the pipeline's executions, ascending."""
    props = store.executionproperty.where((F.col("name") == "Context_Type") & F.col("string_value").isNotNull())
    mine = pipeline_executions(store, pipeline).select(F.col("id").alias("execution_id"))
    return props.join(mine, "execution_id", "left_semi").select(F.col("string_value").alias("stage_name")).distinct().orderBy("stage_name")


def stage_executions(store: MetadataStore, pipeline: str, stage: str) -> DataFrame:
    """execution_id of the pipeline's executions in the stage (JON04)."""
    props = store.executionproperty.where((F.col("name") == "Context_Type") & (F.col("string_value") == stage))
    mine = pipeline_executions(store, pipeline).select(F.col("id").alias("execution_id"))
    return props.select("execution_id").distinct().join(mine, "execution_id", "left_semi")


def stage_artifacts(store: MetadataStore, pipeline: str, stage: str) -> DataFrame:
    """artifact_id of what the stage's executions touch (JON05)."""
    return store.event.join(stage_executions(store, pipeline, stage), "execution_id", "left_semi").select("artifact_id").distinct()


def created_time() -> Column:
    """AGG03: an execution's create_time from its properties; an aggregate."""
    return F.max(F.when(F.col("name") == "original_create_time_since_epoch", F.expr("try_cast(string_value as double)")))


def created_times(props: DataFrame) -> DataFrame:
    """AGG03: execution_id and create_time."""
    return props.where(F.col("name") == "original_create_time_since_epoch").groupBy("execution_id").agg(F.max(F.expr("try_cast(string_value as double)")).alias("create_time"))


def found_executions(store: MetadataStore, pipeline: str, stage: str, search: str = "", among: DataFrame | None = None) -> DataFrame:
    """All that a search for executions of a stage finds: execution_id, execution_properties and create_time; among: ids (id) that it can find."""
    ids = stage_executions(store, pipeline, stage)
    ids = ids if among is None else ids.join(among.select(F.col("id").alias("execution_id")), "execution_id", "left_semi")
    props = store.executionproperty.join(ids, "execution_id", "left_semi")
    rows = ids.join(property_json(props, "execution_id", "execution_properties"), "execution_id", "left").join(created_times(props), "execution_id", "left")
    return rows.where(contains(execution_text(), search)) if search else rows


def execution_text() -> list[Column]:
    """The parts in which a search for executions looks."""
    return [F.col("execution_id").cast("string"), F.col("execution_properties"), *search_tokens(F.col("create_time"))]


def executions_page(store: MetadataStore, pipeline: str, stage: str, page: Page = Page(descending=True), among: DataFrame | None = None) -> DataFrame:
    """SRT01: one page, by creation time, nulls last either way, ties by id."""
    if page.search or among is not None:
        rows = found_executions(store, pipeline, stage, page.search, among).select("execution_id", "create_time")
    else:
        ids = stage_executions(store, pipeline, stage)
        rows = ids.join(created_times(store.executionproperty.join(ids, "execution_id", "left_semi")), "execution_id", "left")
    rows = page.cut(rows, "create_time", "execution_id", True)
    order = F.col("create_time").desc_nulls_last() if page.descending else F.col("create_time").asc_nulls_last()
    return _with_json(rows, store.executionproperty, "execution_id", "execution_properties").select("execution_id", "execution_properties", "create_time").orderBy(order, "execution_id")


def _with_json(rows: DataFrame, props: DataFrame, key: str, out: str) -> DataFrame:
    """The rows of one page, written, with the properties of these alone."""
    rows = stored(rows)
    return rows.join(property_json(props.join(rows.select(key), key, "left_semi"), key, out), key, "left")


def found_artifacts(store: MetadataStore, pipeline: str, stage: str, kind: str, search: str = "") -> DataFrame:
    """All that a search for artifacts of a stage and type finds."""
    ids = stage_artifacts(store, pipeline, stage).select(F.col("artifact_id").alias("id"))
    rows = with_type(store, store.artifact.join(ids, "id", "left_semi")).where(F.col("type") == kind)
    rows = rows.select(F.col("id").alias("artifact_id"), "name", "create_time_since_epoch")
    props = property_json(store.artifactproperty.join(ids.withColumnRenamed("id", "artifact_id"), "artifact_id", "left_semi"), "artifact_id", "artifact_properties")
    rows = rows.join(props, "artifact_id", "left")
    parts = [F.col("artifact_id").cast("string"), F.col("name"), *search_tokens(F.col("create_time_since_epoch")), F.col("artifact_properties")]
    return rows.where(contains(parts, search)) if search else rows


def artifacts_page(store: MetadataStore, pipeline: str, stage: str, kind: str, page: Page = Page()) -> DataFrame:
    """SRT02: one page, by lower-case name, or by creation time for any other column; descending puts nulls first; ties by id."""
    if page.search:
        rows = found_artifacts(store, pipeline, stage, kind, page.search)
    else:
        ids = stage_artifacts(store, pipeline, stage).select(F.col("artifact_id").alias("id"))
        rows = with_type(store, store.artifact.join(ids, "id", "left_semi")).where(F.col("type") == kind).withColumnRenamed("id", "artifact_id")
    key = F.lower("name") if page.sort_column == "name" else F.col("create_time_since_epoch")
    rows = page.cut(rows.select("artifact_id", key.alias("sort_key")), "sort_key", "artifact_id", not page.descending)
    whole = _with_json(rows, store.artifactproperty, "artifact_id", "artifact_properties").join(store.artifact.select(F.col("id").alias("artifact_id"), "name", "create_time_since_epoch"), "artifact_id")
    order = F.col("sort_key").desc_nulls_first() if page.descending else F.col("sort_key").asc_nulls_last()
    return whole.orderBy(order, "artifact_id").select("artifact_id", "name", "create_time_since_epoch", "artifact_properties")


def total(rows: DataFrame) -> DataFrame:
    """WIN01, WIN02: the number of all rows found, as a count by itself: a window over everything would be one task."""
    return rows.agg(F.count("*").alias("total_records"))


def artifact_types(store: MetadataStore, pipeline: str, stage: str) -> DataFrame:
    """The types of what a stage touches, without Environment, ascending."""
    ids = stage_artifacts(store, pipeline, stage).select(F.col("artifact_id").alias("id"))
    kinds = with_type(store, store.artifact.join(ids, "id", "left_semi")).select(F.col("type").alias("artifact_type")).distinct()
    return kinds.where(F.col("artifact_type") != "Environment").orderBy("artifact_type")


def browse(store: MetadataStore, pipeline: str, stage: str, kind: str, page: Page = Page()) -> dict[str, object]:
    """SRT04: {total_items, items} as the REST layer returns them; total_items is 0 on an empty page."""
    items = [r.asDict() for r in artifacts_page(store, pipeline, stage, kind, page).collect()]  # a page
    return {"total_items": total(found_artifacts(store, pipeline, stage, kind, page.search)).first()[0] if items else 0, "items": items}
