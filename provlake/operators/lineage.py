"""Lineage: hops, closures, levels and trees (LIN, AGG11).

Closures over a store go breadth first from artifacts to executions and back, by semi-joins with events: an artifact that
many runs read, or a run of many inputs and outputs, costs its events and never their product. It is a driver loop of joins
whose frontier and visited sets stay DataFrames and are written to the checkpoint folder between hops, as the events are
before the first; only counts reach the driver. So cycles end, a node that is reached by many paths is expanded once, and a
join with a small frontier shuffles nothing. What isn't exhausted after SHALLOW hops, and no longer grows by a share of what
is known, is deep, and the rest goes by contraction (deep.py), whose joins follow the logarithm of the depth. Edges
between artifacts, or between executions, are made only where they are the result, and only among the nodes in question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut, stored
from ..functions.names import execution_label, short_artifact
from ..functions.values import as_text
from ..schema import INPUT, NOT_LINEAGE, OUTPUT
from ..store import MetadataStore
from . import deep
from .catalog import artifact, artifacts_by_ids, execution_ids, executions_by_ids, executions_of_artifacts, lineage_artifacts, pipelines, with_type

#: Hops or levels that go one by one before the rest is contracted.
SHALLOW = 4
#: A frontier of at least this share of what is reached is walked on, as such a walk is over in few hops.
GROWING = 1 / 4


def inputs(store: MetadataStore) -> DataFrame:
    return store.event.where(F.col("type") == INPUT).select("artifact_id", "execution_id")


def outputs(store: MetadataStore) -> DataFrame:
    return store.event.where(F.col("type") == OUTPUT).select("artifact_id", "execution_id")


def _in_pipeline(store: MetadataStore, rows: DataFrame, pipeline_id: int | DataFrame | None, key: str = "execution_id") -> DataFrame:
    """rows whose execution belongs to the pipeline (an id, or a frame with column id), or all."""
    if pipeline_id is None:
        return rows
    mine = _stages_of(store, pipeline_id)
    ids = store.association.join(mine, "context_id", "left_semi").select(F.col("execution_id").alias(key))
    return rows.join(ids, key, "left_semi")


def _stages_of(store: MetadataStore, pipeline_id: int | DataFrame) -> DataFrame:
    """context_id of the pipeline's stages."""
    if isinstance(pipeline_id, DataFrame):
        return store.parentcontext.join(pipeline_id.select(F.col("id").alias("parent_context_id")), "parent_context_id", "left_semi").select("context_id")
    return store.parentcontext.where(F.col("parent_context_id") == pipeline_id).select("context_id")


def consumers(store: MetadataStore, artifact_id: int, pipeline_id: int | None = None) -> DataFrame:
    """LIN01: distinct executions that read the artifact."""
    return _in_pipeline(store, inputs(store).where(F.col("artifact_id") == artifact_id).select("execution_id").distinct(), pipeline_id)


def producers(store: MetadataStore, artifact_id: int, pipeline_id: int | None = None) -> DataFrame:
    """LIN02: executions that wrote the artifact, once for each event."""
    return _in_pipeline(store, outputs(store).where(F.col("artifact_id") == artifact_id).select("execution_id"), pipeline_id)


def _touched(side: DataFrame, executions: DataFrame) -> DataFrame:
    return side.join(executions.select(F.col("id").alias("execution_id")), "execution_id", "left_semi").select(F.col("artifact_id").alias("id")).distinct()


def output_artifacts(store: MetadataStore, executions: DataFrame) -> DataFrame:
    """LIN03: distinct ids of what the executions (id) wrote."""
    return _touched(outputs(store), executions)


def input_artifacts(store: MetadataStore, executions: DataFrame) -> DataFrame:
    """LIN04: distinct ids of what the executions (id) read."""
    return _touched(inputs(store), executions)


def artifact_edges(store: MetadataStore, pipeline_id: int | DataFrame | None = None) -> DataFrame:
    """(parent, child): artifacts that one execution read and wrote (JON19). An artifact that it did both to isn't its own parent."""
    read = _in_pipeline(store, inputs(store), pipeline_id).withColumnRenamed("artifact_id", "parent")
    wrote = outputs(store).withColumnRenamed("artifact_id", "child")
    return read.join(wrote, "execution_id").where("parent != child").select("parent", "child").distinct()


def execution_edges(store: MetadataStore, pipeline_id: int | DataFrame | None = None) -> DataFrame:
    """(parent, child): an execution that wrote what another read; both in the pipeline, where one is named."""
    wrote = _in_pipeline(store, outputs(store), pipeline_id).withColumnRenamed("execution_id", "parent")
    read = _in_pipeline(store, inputs(store), pipeline_id).withColumnRenamed("execution_id", "child")
    return wrote.join(read, "artifact_id").where("parent != child").select("parent", "child").distinct()


def children(store: MetadataStore, artifact_id: int, pipeline_id: int | None = None) -> DataFrame:
    """LIN05: artifacts one hop down."""
    read = consumers(store, artifact_id, pipeline_id).withColumnRenamed("execution_id", "id")
    return artifacts_by_ids(store, output_artifacts(store, read))


def parents(store: MetadataStore, artifact_id: int, lineage_only: bool = False) -> DataFrame:
    """LIN06: artifacts one hop up; LIN07 without Environment and Label."""
    wrote = producers(store, artifact_id).withColumnRenamed("execution_id", "id")
    rows = artifacts_by_ids(store, input_artifacts(store, wrote))
    return rows.where(~F.col("type").isin(*NOT_LINEAGE)) if lineage_only else rows


def closure(edges: DataFrame, start: DataFrame, max_hops: int | None = None, stop: Column | None = None) -> DataFrame:
    """LIN08, LIN09, LIN13, LIN16, LIN24: (id, hops) of all nodes that edges (parent, child) lead to from start (id).

    The start has 0 hops. stop: nodes (id) that are reached but not expanded. Edges are cut to a table once, since each
    hop reads them; hops alternate joins of a small frontier with them and an anti-join with what is visited. Beyond
    SHALLOW hops, where no number of hops is asked for, the rest of the graph is contracted once the frontier stops growing.
    """
    edges = stored(edges.select("parent", "child"))
    visited = stored(start.select("id").distinct().withColumn("hops", F.lit(0)))
    frontier, hops = visited, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        open_ends = frontier if stop is None else frontier.where(~stop)
        reached = edges.join(open_ends.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
        frontier = stored(reached.join(visited, "id", "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if hops >= SHALLOW and max_hops is None and not _growing(frontier, visited):
            way = edges.join(visited.select(F.col("id").alias("child")), "child", "left_anti")
            way = way if stop is None else way.withColumn("id", F.col("parent")).where(~stop)
            beyond = deep.distances(way.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(1).alias("w")), frontier).where("hops > 0")
            return visited.unionByName(beyond.withColumn("hops", F.col("hops") + hops))
    return visited


def _growing(frontier: DataFrame, reached: DataFrame) -> bool:
    """Whether a frontier is a good share of what is reached with it."""
    return frontier.count() >= GROWING * reached.count()


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))


def walk(store: MetadataStore, start: DataFrame, down: bool, max_hops: int | None = None, stop_artifacts: Column | None = None, stop_executions: Column | None = None, max_nodes: int | None = None, pipeline_id: int | DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """LIN08-10, LIN13, LIN24: (id, hops) of the artifacts, and of the executions, that lie below (or above) start (artifacts: id).

    A hop leads from artifacts over executions to artifacts. stop_artifacts, stop_executions: nodes (id) that are reached
    but not expanded. max_nodes: no further hop is made once so many nodes are reached, so hops stay whole.
    """
    read, wrote = (stored(_in_pipeline(store, side(store), pipeline_id)) for side in (inputs, outputs))
    return _walk(*((read, wrote) if down else (wrote, read)), start, max_hops, stop_artifacts, stop_executions, max_nodes)


def _walk(near: DataFrame, far: DataFrame, start: DataFrame, max_hops: int | None = None, stop_artifacts: Column | None = None, stop_executions: Column | None = None, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """walk() over written events: near from artifacts to executions, far from those to artifacts."""
    artifacts = stored(start.select("id").distinct().withColumn("hops", F.lit(0)))
    runs = artifacts.limit(0)
    frontier, hops, reached = artifacts, 0, artifacts.count() if max_nodes else 0
    expand = lambda df, stop: df if stop is None else df.where(~stop)
    while (max_hops is None or hops < max_hops) and (max_nodes is None or reached < max_nodes):
        hops += 1
        met = near.join(expand(frontier, stop_artifacts).select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi").select(F.col("execution_id").alias("id")).distinct()
        met = stored(met.join(runs, "id", "left_anti").withColumn("hops", F.lit(hops)))
        if met.isEmpty():
            break
        beyond = far.join(expand(met, stop_executions).select(F.col("id").alias("execution_id")), "execution_id", "left_semi").select(F.col("artifact_id").alias("id")).distinct()
        frontier = stored(beyond.join(artifacts, "id", "left_anti").withColumn("hops", F.lit(hops)))
        runs, artifacts = runs.unionByName(met), artifacts.unionByName(frontier)
        if hops % 8 == 0:
            runs, artifacts = stored(runs.repartition("id")), stored(artifacts.repartition("id"))
        if frontier.isEmpty():
            break
        if max_nodes is not None:
            reached = artifacts.count() + runs.count()
        elif hops >= SHALLOW and max_hops is None and not _growing(frontier, artifacts):
            below, above = _walk_deep(near, far, artifacts, runs, frontier, hops, stop_artifacts, stop_executions)
            return artifacts.unionByName(below), runs.unionByName(above)
    return artifacts, runs


def _walk_deep(near: DataFrame, far: DataFrame, artifacts: DataFrame, runs: DataFrame, frontier: DataFrame, hops: int, stop_artifacts: Column | None, stop_executions: Column | None) -> tuple[DataFrame, DataFrame]:
    """What a walk reaches from its frontier after some hops, in one graph: artifacts have even numbers, executions odd ones."""
    a, e = F.col("artifact_id") * 2, F.col("execution_id") * 2 + 1
    new = lambda side, known, key: side.join(known.select(F.col("id").alias(key)), key, "left_anti")
    go = lambda side, stop, key: side if stop is None else side.withColumn("id", F.col(key)).where(~stop)
    # a number of events between two nodes is one edge; a step from an artifact to a run is a hop
    onward = go(new(near, runs, "execution_id"), stop_artifacts, "artifact_id").select(a.alias("src"), e.alias("dst"), F.lit(1).alias("w"))
    back = go(new(far, artifacts, "artifact_id"), stop_executions, "execution_id").select(e.alias("src"), a.alias("dst"), F.lit(0).alias("w"))
    met = cut(deep.distances(onward.unionByName(back), frontier.select((F.col("id") * 2).alias("id"))).withColumn("hops", F.col("hops") + hops))
    start = frontier.select("id")
    halves = [met.where(F.pmod("id", F.lit(2)) == odd).select(F.floor(F.col("id") / 2).cast("long").alias("id"), "hops") for odd in (0, 1)]
    return halves[0].join(start, "id", "left_anti"), halves[1]


def descendants(store: MetadataStore, artifact_id: int, max_hops: int | None = None) -> DataFrame:
    """LIN08: (id, hops) of all artifacts below."""
    return walk(store, store.artifact.where(F.col("id") == artifact_id), True, max_hops)[0].where("hops > 0")


def ancestors(store: MetadataStore, artifact_id: int, max_hops: int | None = None) -> DataFrame:
    """LIN09: (id, hops) of all artifacts above."""
    return walk(store, store.artifact.where(F.col("id") == artifact_id), False, max_hops)[0].where("hops > 0")


def ancestor_executions(store: MetadataStore, artifact_id: int, max_hops: int | None = None) -> DataFrame:
    """LIN10: executions that wrote an artifact above; the artifact's own producer isn't one by that."""
    above = ancestors(store, artifact_id, max_hops).select(F.col("id").alias("artifact_id"))
    return outputs(store).join(above, "artifact_id", "left_semi").select(F.col("execution_id").alias("id")).distinct()


def parent_executions(store: MetadataStore, executions: DataFrame, pipeline_id: int | None = None) -> DataFrame:
    """LIN11: distinct ids of the executions that wrote what these (id) read."""
    read = _touched(inputs(store), executions).select(F.col("id").alias("artifact_id"))
    wrote = _in_pipeline(store, outputs(store).join(read, "artifact_id", "left_semi"), pipeline_id)
    return wrote.select(F.col("execution_id").alias("id")).distinct()


def parent_execution_ids(store: MetadataStore, execution_id: int, pipeline_id: int | None = None) -> DataFrame:
    """LIN12: the same for one execution, once for each artifact between them."""
    read = inputs(store).where(F.col("execution_id") == execution_id).select("artifact_id")
    return _in_pipeline(store, outputs(store).join(read, "artifact_id"), pipeline_id).select(F.col("execution_id").alias("id"))


def upstream_graph(store: MetadataStore, executions: DataFrame, pipeline_id: int | DataFrame | None = None, max_hops: int | None = None) -> tuple[DataFrame, DataFrame]:
    """LIN13: the executions (id, hops) above these and the edges (source, target) between them."""
    start = stored(executions.select("id").distinct())
    every = [stored(side(store)) for side in (inputs, outputs)]
    read, wrote = every if pipeline_id is None else (stored(_in_pipeline(store, side, pipeline_id)) for side in every)
    first = read.join(start.select(F.col("id").alias("execution_id")), "execution_id", "left_semi").select(F.col("artifact_id").alias("id"))
    above = _walk(wrote, read, first, max_hops)[1]
    nodes = stored(start.withColumn("hops", F.lit(0)).unionByName(above.join(start, "id", "left_anti")))
    mine = nodes.select(F.col("id").alias("execution_id"))
    wrote = every[1].join(mine, "execution_id", "left_semi").select("artifact_id", F.col("execution_id").alias("source"))
    read = every[0].join(mine, "execution_id", "left_semi").select("artifact_id", F.col("execution_id").alias("target"))
    return nodes, wrote.join(read, "artifact_id").where("source != target").select("source", "target").distinct()


def producer(store: MetadataStore, name: str) -> DataFrame:
    """LIN14: of the executions that wrote the artifact of that name the one with the smallest id."""
    mine = artifact(store, name).select(F.col("id").alias("artifact_id"))
    return outputs(store).join(mine, "artifact_id", "left_semi").agg(F.min("execution_id").alias("id")).where("id is not null")


def levels(nodes: DataFrame, edges: DataFrame, max_levels: int | None = None) -> DataFrame:
    """LIN19: (id, level): 0 without parents among the nodes, else one more than the highest parent's; cycles have none.

    Kahn's order as an iterated peel: nodes whose parents all have levels get the next. Each round counts placed parents
    by a grouped join; nodes on cycles, and those below them, never fill up. Beyond SHALLOW levels, where no number of
    them is asked for, the rest of the graph is contracted.
    """
    edges = cut(edges.select("parent", "child").distinct().join(nodes.select(F.col("id").alias("child")), "child", "left_semi").join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi"))
    waiting = nodes.select("id").distinct().join(edges.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("open")), "id", "left")
    waiting = cut(waiting.select("id", F.coalesce("open", F.lit(0)).alias("open")))
    done, level = None, 0
    while max_levels is None or level < max_levels:
        ready = cut(waiting.where("open = 0").select("id", F.lit(level).alias("level")))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        filled = edges.join(ready.select(F.col("id").alias("parent")), "parent", "left_semi").groupBy(F.col("child").alias("id")).agg(F.count("*").alias("filled"))
        waiting = cut(waiting.where("open > 0").join(filled, "id", "left").select("id", (F.col("open") - F.coalesce("filled", F.lit(0))).alias("open")))
        level += 1
        if level == SHALLOW and max_levels is None and not waiting.isEmpty():
            return done.unionByName(_levels_deep(done, waiting.select("id"), edges))
    return nodes.select("id").limit(0).withColumn("level", F.lit(0)) if done is None else done


def _levels_deep(done: DataFrame, waiting: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of the nodes that a peel left waiting after SHALLOW levels: those below a placed node are SHALLOW at least."""
    mine = edges.join(waiting.select(F.col("id").alias("child")), "child", "left_semi").join(done.select(F.col("id").alias("parent")), "parent", "left_anti")
    return deep.longest_paths(waiting, mine.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(1).alias("w"))).withColumn("level", F.col("level") + SHALLOW)


def sibling_groups(nodes: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """AGG11, ARR02: nodes (id, label, level) grouped by their sorted parents: level, parents and members, as labels."""
    names = nodes.select(F.col("id").alias("parent"), F.col(label).alias("parent_label"))
    up = edges.join(names, "parent").groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_list("parent")).alias("parents"), F.array_sort(F.collect_list("parent_label")).alias("parent_labels"))
    rows = nodes.join(up, "id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    rows = rows.withColumns({"parents": none("parents", dict(nodes.dtypes)["id"]), "parent_labels": none("parent_labels", "string")})
    return rows.groupBy("parents").agg(F.min("level").alias("level"), F.first("parent_labels").alias("parent_labels"), F.array_sort(F.collect_list(label)).alias("members"))


def _without_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a parent that isn't a node itself, and without what such nodes lead to (the strict order's quirk)."""
    lost = edges.join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti").select(F.col("child").alias("id")).distinct()
    return nodes.join(closure(edges, lost), "id", "left_anti")


def _pipeline_ids(store: MetadataStore, name: str) -> DataFrame:
    return pipelines(store, name).agg(F.min("id").alias("id"))


def execution_tree(store: MetadataStore, pipeline: str, uuid: str) -> DataFrame:
    """LIN15: the executions above the one whose uuid begins with these four characters, layered and grouped; empty if there's none."""
    ids = execution_ids(store, pipeline)
    start = ids.where(F.substring("Execution_uuid", 1, 4) == uuid).orderBy("id").limit(1)
    nodes, edges = upstream_graph(store, start, _pipeline_ids(store, pipeline))
    edges = edges.select(F.col("source").alias("parent"), F.col("target").alias("child"))
    named = ids.select("id", execution_label("Context_Type", "Execution_uuid").alias("label")).dropDuplicates(["id"])
    return sibling_groups(levels(nodes, edges).join(named, "id"), edges)


def artifact_graph(store: MetadataStore, pipeline: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """LIN17: nodes (id, label) and edges (parent, child) of a pipeline's artifacts.

    A parent from another pipeline is left out, or with strict takes everything below it along, as the reference does.
    """
    mine = store.attribution.join(_stages_of(store, _pipeline_ids(store, pipeline)), "context_id", "left_semi")
    nodes = lineage_artifacts(store).join(mine.select(F.col("artifact_id").alias("id")), "id", "left_semi").select("id", short_artifact("name", "type").alias("label"))
    allowed = lineage_artifacts(store).select("id")
    read = inputs(store).join(allowed.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi").withColumnRenamed("artifact_id", "parent")
    wrote = outputs(store).join(nodes.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi").withColumnRenamed("artifact_id", "child")
    edges = read.join(wrote, "execution_id").where("parent != child").select("parent", "child").distinct()
    if strict:
        nodes = _without_roots(nodes, edges)
    return nodes, edges.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").join(nodes.select(F.col("id").alias("child")), "child", "left_semi")


def artifact_tree(store: MetadataStore, pipeline: str, strict: bool = False, max_levels: int | None = None) -> DataFrame:
    """LIN17, layered and grouped."""
    nodes, edges = artifact_graph(store, pipeline, strict)
    return sibling_groups(nodes.join(levels(nodes, edges, max_levels), "id"), edges)


def bipartite_graph(store: MetadataStore, pipeline: str) -> tuple[DataFrame, DataFrame]:
    """LIN18: nodes (id, label) a_<artifact> and e_<execution> of a pipeline, and edges (parent, child) between them."""
    events = _in_pipeline(store, store.event, _pipeline_ids(store, pipeline)).join(lineage_artifacts(store).select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi")
    a, e = F.concat(F.lit("a_"), "artifact_id"), F.concat(F.lit("e_"), "execution_id")
    read = F.col("type") == INPUT
    edges = events.select(F.when(read, a).otherwise(e).alias("parent"), F.when(read, e).otherwise(a).alias("child")).distinct()
    artifacts = lineage_artifacts(store).join(events.select(F.col("artifact_id").alias("id")), "id", "left_semi")
    artifacts = artifacts.select(F.concat(F.lit("a_"), "id").alias("id"), F.concat(F.lit("artifact_name_"), short_artifact("name", "type")).alias("label"))
    runs = execution_ids(store, pipeline).join(events.select(F.col("execution_id").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    runs = runs.select(F.concat(F.lit("e_"), "id").alias("id"), F.concat(F.lit("execution_name_"), "Context_Type", F.lit(":"), F.substring("Execution_uuid", 1, 4)).alias("label"))
    return artifacts.unionByName(runs), edges


def force_graph(store: MetadataStore, pipeline: str) -> tuple[DataFrame, DataFrame]:
    """LIN22: nodes and links (source, target) of a pipeline's executions."""
    nodes = execution_ids(store, pipeline).select("id", execution_label("Context_Type", "Execution_uuid").alias("name")).distinct()
    return nodes, execution_edges(store, _pipeline_ids(store, pipeline)).select(F.col("parent").alias("source"), F.col("child").alias("target"))


def spans(leveled: DataFrame, edges: DataFrame) -> DataFrame:
    """LIN23: for each node the levels between it and its highest parent, 0 without parents."""
    up = edges.join(leveled.select(F.col("id").alias("parent"), F.col("level").alias("parent_level")), "parent").groupBy(F.col("child").alias("id")).agg(F.min("parent_level").alias("top"))
    return leveled.join(up, "id", "left").select("id", "level", F.coalesce(F.col("level") - F.col("top"), F.lit(0)).alias("span"))


def execution_list(store: MetadataStore, pipeline: str) -> DataFrame:
    """LIN21: the short names of a pipeline's executions."""
    return execution_ids(store, pipeline).select("id", execution_label("Context_Type", "Execution_uuid").alias("name"))


def model_card(store: MetadataStore, model_id: int) -> dict[str, DataFrame]:
    """LIN20: model, executions, inputs and outputs; all empty if the id isn't a model's."""
    one = store.artifact.where(F.col("id") == model_id)
    model = artifacts_by_ids(store, with_type(store, one).where(F.col("type") == "Model"))
    runs = executions_of_artifacts(store, model).select(F.col("execution_id").alias("id")).distinct()
    executions = executions_by_ids(store, runs)
    kept = F.map_filter("properties", lambda k, _: ~k.isin("Git_Start_Commit", "Git_End_Commit"))
    other = lambda ids: artifacts_by_ids(store, ids.where(F.col("id") != model_id))
    return {"model": model, "executions": executions.withColumn("properties", kept), "inputs": other(input_artifacts(store, runs)), "outputs": other(output_artifacts(store, runs))}


def compare(items: DataFrame, props: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """LIN25, SET05: a row for each property of the items: one column for each id, a dash where missing, and whether they differ."""
    mine = props.where(F.col(key).isin(ids)).groupBy(key, "name").agg(F.array_join(F.array_sort(F.collect_set(as_text())), ", ").alias("value"))
    cells = [F.coalesce(F.max(F.when(F.col(key) == i, F.col("value"))), F.lit("—")).alias(f"item_{i}") for i in ids]
    rows = mine.groupBy("name").agg(*cells)
    return rows.withColumn("differs", F.size(F.array_distinct(F.array(*(F.col(f"item_{i}") for i in ids)))) > 1)
