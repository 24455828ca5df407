"""The property graph as vertices and edges (GRF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoint import stored
from ..functions.values import property_map
from ..schema import INPUT
from ..store import MetadataStore
from .catalog import with_type
from .lineage import inputs, outputs


def context_vertices(store: MetadataStore) -> DataFrame:
    """GRF01: pipelines and stages, one vertex for each set of all values."""
    rows = store.pipelines.select("id", F.lit("Pipeline").alias("label"), "name").unionByName(store.stages.select("id", F.lit("Stage").alias("label"), "name"))
    return rows.dropDuplicates()


def execution_vertices(store: MetadataStore) -> DataFrame:
    """GRF01: executions with their properties."""
    props = property_map(store.executionproperty, "execution_id").withColumnRenamed("execution_id", "id")
    return store.execution.select("id", F.lit("Execution").alias("label"), "name").join(props, "id", "left")


def artifact_vertices(store: MetadataStore) -> DataFrame:
    """GRF02, GRF03: one vertex for each uri and type, with the sets of its names and ids."""
    rows = with_type(store, store.artifact)
    return rows.groupBy("uri", F.col("type").alias("label")).agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("id")).alias("ids"))


def append_distinct(values: Column, value: Column) -> Column:
    """AGG15: an array with the value at its end and nowhere else."""
    return F.array_append(F.array_remove(F.coalesce(values, F.array().cast("array<string>")), value), value)


def structure_edges(store: MetadataStore) -> DataFrame:
    """GRF04: contains (pipeline to stage) and runs (stage to execution)."""
    contains = store.parentcontext.select(F.lit("contains").alias("relation"), F.col("parent_context_id").alias("src"), F.col("context_id").alias("dst"))
    runs = store.association.select(F.lit("runs").alias("relation"), F.col("context_id").alias("src"), F.col("execution_id").alias("dst"))
    return contains.unionByName(runs)


def event_edges(store: MetadataStore) -> DataFrame:
    """GRF05: input (artifact to execution) and output (execution to artifact)."""
    read = F.col("type") == INPUT
    return store.event.select(F.when(read, "input").otherwise("output").alias("relation"), F.when(read, F.col("artifact_id")).otherwise(F.col("execution_id")).alias("src"), F.when(read, F.col("execution_id")).otherwise(F.col("artifact_id")).alias("dst"))


def derivation_edges(store: MetadataStore, name_property: str = "Execution_type_name", properties: tuple[str, ...] = ()) -> DataFrame:
    """GRF06: artifact to artifact, labelled with the execution's name without anything but word characters.

    properties: names of execution properties that the edge carries as a map; of several executions with one name between
    two artifacts the last one's.
    """
    wrote = outputs(store).select(F.col("artifact_id").alias("dst"), "execution_id")
    pairs = inputs(store).select(F.col("artifact_id").alias("src"), "execution_id").join(wrote, "execution_id").where("src != dst")
    names = store.executionproperty.where(F.col("name") == name_property).select("execution_id", F.regexp_replace("string_value", r"\W+", "").alias("relation"))
    rows = pairs.join(names, "execution_id")
    if not properties:
        return rows.select("relation", "src", "dst").distinct()
    props = property_map(store.executionproperty.where(F.col("name").isin(*properties)), "execution_id")
    rows = rows.groupBy("relation", "src", "dst").agg(F.max("execution_id").alias("execution_id")).join(props, "execution_id", "left")
    return rows.select("relation", "src", "dst", "properties")


def linked_edges(store: MetadataStore, present: DataFrame | None = None) -> DataFrame:
    """GRF07, JON17: for each execution the first producer that it isn't linked to yet; present: edges (src, dst).

    Without present edges the two smallest producers of each artifact are enough, as one of them isn't the reader itself;
    a reader of n present edges needs the n + 2 smallest. So no artifact's producers are multiplied by its readers.
    """
    if present is not None:
        linked = stored(present.select("src", "dst"))
        many = linked.groupBy("dst").agg(F.count("*").alias("n"))
        most = many.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        nth = F.dense_rank().over(Window.partitionBy("artifact_id").orderBy("execution_id"))  # an execution's repeated events count once
        wrote = outputs(store).withColumn("nth", nth).where(F.col("nth") <= most + 2).select("artifact_id", F.col("execution_id").alias("src"), "nth")
        read = inputs(store).withColumnRenamed("execution_id", "dst").join(many, "dst", "left").select("artifact_id", "dst", F.coalesce("n", F.lit(0)).alias("n"))
        rows = read.join(wrote, "artifact_id").where("nth <= n + 2 and src != dst").select("src", "dst")
        return rows.join(linked, ["src", "dst"], "left_anti").groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")
    wrote = outputs(store)
    first = wrote.groupBy("artifact_id").agg(F.min("execution_id").alias("first"))
    second = wrote.join(first, "artifact_id").where("execution_id > first").groupBy("artifact_id").agg(F.min("execution_id").alias("second"))
    two = first.join(second, "artifact_id", "left")
    rows = inputs(store).join(two, "artifact_id").select(F.when(F.col("first") != F.col("execution_id"), F.col("first")).otherwise(F.col("second")).alias("src"), F.col("execution_id").alias("dst"))
    return rows.where("src is not null").groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")


def typed_edges(store: MetadataStore, relation: str, source_type: str, target_type: str) -> DataFrame:
    """GRF08: derivations from artifacts of one type to those of another, under a name such as has_label or derived."""
    kinds = with_type(store, store.artifact).select("id", "type")
    ids = lambda kind: kinds.where(F.col("type") == kind).select(F.col("id").alias("artifact_id"))
    read = inputs(store).join(ids(source_type), "artifact_id", "left_semi").withColumnRenamed("artifact_id", "src")
    wrote = outputs(store).join(ids(target_type), "artifact_id", "left_semi").withColumnRenamed("artifact_id", "dst")
    return read.join(wrote, "execution_id").where("src != dst").select(F.lit(relation).alias("relation"), "src", "dst").distinct()


def find_vertices(vertices: DataFrame, label: str, uri: str | None = None, name: str | None = None) -> DataFrame:
    """GRF09, JON20: by uri or by one of the names."""
    rows = vertices.where(F.col("label") == label)
    rows = rows if uri is None else rows.where(F.col("uri") == uri)
    return rows if name is None else rows.where(F.array_contains("names", name))
