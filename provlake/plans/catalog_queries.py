"""Catalog and browse queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, times, values
from ..checkpoint import scratch_path
from ..operators import browse, catalog, export, paging, search
from ..operators.browse import Page
from ..store import MetadataStore
from .registry import query

P, S = "ASIA", "ASIA/NATION_17"
_PID = f"(SELECT min(id) FROM context WHERE type_id = 1 AND name = '{P}')"
_STAGE = f"(SELECT id FROM context WHERE type_id = 2 AND name = '{S}')"
_RUNS = f"SELECT execution_id FROM association WHERE context_id IN (SELECT context_id FROM parentcontext WHERE parent_context_id = {_PID})"
_TEXT = "coalesce(string_value, bool_value::VARCHAR, double_value::VARCHAR, int_value::VARCHAR, 'NULL')"

#: Name and uuids of each execution, in one pass over the properties.
NAMED = "SELECT execution_id, max(CASE WHEN name = 'Context_Type' THEN string_value END) AS kind, max(CASE WHEN name = 'Execution_uuid' THEN string_value END) AS uuid FROM executionproperty WHERE name IN ('Context_Type', 'Execution_uuid') GROUP BY execution_id"


def _columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def _map_text(df: DataFrame) -> DataFrame:
    """id and the property map as sorted text, so that engines compare."""
    entries = F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return df.select("id", F.array_join(entries, ";").alias("properties"))


def _map_sql(ids: str, props: str, key: str) -> str:
    entity = "execution" if key == "execution_id" else "artifact"
    return f"""SELECT e.id, coalesce(m.properties, '') AS properties FROM {entity} e LEFT JOIN (
        SELECT {key} AS id, array_to_string(list_sort(list(DISTINCT CASE WHEN is_custom_property THEN 'custom_properties_' ELSE '' END || name || '=' || {_TEXT})), ';') AS properties FROM {props} GROUP BY 1) m ON e.id = m.id
        WHERE e.id IN ({ids})"""


@query("flt01_pipelines", "SELECT id, name FROM context WHERE type_id = 1")
def _(s: MetadataStore) -> DataFrame:
    return _columns(catalog.pipelines(s), "id", "name")


@query("flt02_pipeline", f"SELECT id, name FROM context WHERE id = {_PID}")
def _(s: MetadataStore) -> DataFrame:
    return _columns(catalog.pipeline(s, P), "id", "name")


@query("flt03_pipeline_names", "SELECT name FROM context WHERE type_id = 1")
def _(s: MetadataStore) -> DataFrame:
    return catalog.pipeline_names(s)


@query("flt04_pipeline_id", f"SELECT coalesce({_PID}, -1) AS id UNION ALL SELECT -1")
def _(s: MetadataStore) -> DataFrame:
    return catalog.pipeline_id(s, P).union(catalog.pipeline_id(s, "no such pipeline"))


@query("flt05_stages", "SELECT id, name FROM context JOIN parentcontext ON id = context_id WHERE parent_context_id = 1002")
def _(s: MetadataStore) -> DataFrame:
    return _columns(catalog.stages(s, 1002), "id", "name")


@query("flt06_stage_names", f"SELECT name FROM context JOIN parentcontext ON id = context_id WHERE parent_context_id = {_PID}")
def _(s: MetadataStore) -> DataFrame:
    return catalog.stage_names(s, P)


@query("flt07_executions", "SELECT id, last_known_state FROM execution WHERE id IN (SELECT execution_id FROM association WHERE context_id = 2005)")
def _(s: MetadataStore) -> DataFrame:
    return _columns(catalog.executions(s, 2005), "id", "last_known_state")


@query("flt08_raw_executions_of_stage", f"SELECT id, name, create_time_since_epoch FROM execution WHERE id IN (SELECT execution_id FROM association WHERE context_id = {_STAGE})")
def _(s: MetadataStore) -> DataFrame:
    return _columns(catalog.raw_executions_of_stage(s, S), "id", "name", "create_time_since_epoch")


@query("flt09_executions_of_stage", _map_sql(f"SELECT execution_id FROM association WHERE context_id = {_STAGE}", "executionproperty", "execution_id"))
def _(s: MetadataStore) -> DataFrame:
    return _map_text(catalog.executions_of_stage(s, S))


@query("flt10_executions_of_pipeline", _map_sql(_RUNS, "executionproperty", "execution_id"))
def _(s: MetadataStore) -> DataFrame:
    return _map_text(catalog.executions_of_pipeline(s, P))


@query("flt11_executions_by_ids", _map_sql("SELECT id FROM execution", "executionproperty", "execution_id"))
def _(s: MetadataStore) -> DataFrame:
    return _map_text(catalog.executions_by_ids(s, s.execution.select("id")))


@query("flt12_short_executions", "SELECT execution_id AS id, max(string_value) FILTER (name = 'Execution_type_name') AS \"Execution_type_name\", max(string_value) FILTER (name = 'Execution_uuid') AS \"Execution_uuid\" FROM executionproperty GROUP BY 1")
def _(s: MetadataStore) -> DataFrame:
    return catalog.short_executions(s, s.execution.select("id"))


@query("flt13_executions_by_stage", "SELECT min(execution_id) AS id FROM association WHERE context_id = 2003 AND execution_id % 10 = 0")
def _(s: MetadataStore) -> DataFrame:
    mine = s.association.where("context_id = 2003 AND execution_id % 10 = 0").agg(F.min("execution_id")).first()[0]
    return catalog.executions_by_stage(s, 2003, hashlib.md5(b"c%d" % mine).hexdigest()).select("id")


@query("flt14_artifact", "SELECT id, name, CASE type_id WHEN 11 THEN 'Dataset' WHEN 12 THEN 'Model' WHEN 13 THEN 'Metrics' WHEN 14 THEN 'Environment' ELSE 'Label' END AS type FROM artifact WHERE name = (SELECT name FROM artifact WHERE id = 17)")
def _(s: MetadataStore) -> DataFrame:
    wanted = s.artifact.where("id = 17").select("name").first()[0]
    return _columns(catalog.artifact(s, f" {wanted} "), "id", "name", "type")


@query("flt16_artifact_names", "SELECT name FROM artifact")
def _(s: MetadataStore) -> DataFrame:
    return catalog.artifact_names(s)


@query("flt17_artifacts_by_ids", _map_sql("SELECT id FROM artifact", "artifactproperty", "artifact_id"))
def _(s: MetadataStore) -> DataFrame:
    return _map_text(catalog.artifacts_by_ids(s, s.artifact.select("id")))


@query("flt18_artifact_types", "SELECT DISTINCT type.name FROM type JOIN artifact ON type.id = type_id")
def _(s: MetadataStore) -> DataFrame:
    return catalog.artifact_types(s)


@query("flt19_artifact_types_without_environment", "SELECT DISTINCT type.name FROM type JOIN artifact ON type.id = type_id WHERE type.name <> 'Environment'")
def _(s: MetadataStore) -> DataFrame:
    return catalog.artifact_types(s, environment=False)


@query("flt20_artifacts_of_pipeline", f"SELECT a.id, t.name AS type FROM artifact a JOIN attribution x ON a.id = x.artifact_id JOIN type t ON a.type_id = t.id WHERE x.context_id IN (SELECT context_id FROM parentcontext WHERE parent_context_id = {_PID})")
def _(s: MetadataStore) -> DataFrame:
    return _columns(catalog.artifacts_of_pipeline(s, P, distinct=False), "id", "type")


@query("flt21_entity_frame", f"""SELECT a.id, a.name, max({_TEXT}) FILTER (p.name = 'kind') AS kind, max({_TEXT}) FILTER (p.name = 'size') AS size
    FROM artifact a LEFT JOIN artifactproperty p ON a.id = p.artifact_id GROUP BY a.id, a.name""")
def _(s: MetadataStore) -> DataFrame:
    return catalog.entity_frame(s.artifact.select("id", "name"), s.artifactproperty, "artifact_id", ["kind", "size"])


@query("flt22_node_attributes", "SELECT id, '{\"id\":' || id || CASE WHEN name <> '' THEN ',\"name\":\"' || name || '\"' ELSE '' END || ',\"last_known_state\":' || last_known_state || '}' AS attributes FROM execution")
def _(s: MetadataStore) -> DataFrame:
    return catalog.node_attributes(s.execution, ["id", "name", "last_known_state"])


@query("flt23_lineage_artifacts", "SELECT a.id, t.name AS type FROM artifact a JOIN type t ON a.type_id = t.id WHERE t.name NOT IN ('Environment', 'Label')")
def _(s: MetadataStore) -> DataFrame:
    return _columns(catalog.lineage_artifacts(s), "id", "type")


@query("flt24_search_artifacts", """SELECT id, name FROM artifact WHERE split_part(split_part(name, ':', 1), '/', -1) = 'small widget' OR split_part(name, ':', 1) = 'small widget' OR name = 'small widget'""")
def _(s: MetadataStore) -> DataFrame:
    return catalog.search_artifacts(s, " small widget ")


@query("flt25_search_artifact", "SELECT id, name FROM artifact WHERE split_part(name, ':', 1) = 'artifacts/large bolt' ORDER BY id LIMIT 1")
def _(s: MetadataStore) -> DataFrame:
    return catalog.search_artifact(s, "artifacts/large bolt")


@query("flt26_executions_by_uuid", f"SELECT execution_id AS id FROM executionproperty WHERE name = 'Execution_uuid' AND execution_id IN ({_RUNS}) AND list_contains(string_split(string_value, ','), (SELECT max(md5('x' || e.id)) FROM execution e WHERE e.id IN ({_RUNS})))")
def _(s: MetadataStore) -> DataFrame:
    uuid = catalog.execution_ids(s, P).agg(F.max(F.md5(F.concat(F.lit("x"), F.col("id").cast("string"))))).first()[0]
    return catalog.executions_by_uuid(s, P, uuid).select("id")


@query("flt27_complete_columns", "SELECT name, id FROM artifact")
def _(s: MetadataStore) -> DataFrame:
    rows = s.artifact.select("id", "name").withColumn("gaps", F.when(F.col("id") % 2 == 0, F.col("id")))
    return catalog.complete_columns(rows, ["name"])


@query("flt34_execution_ids", f"""SELECT p.execution_id AS id, kind AS "Context_Type", uuid AS "Execution_uuid", a.context_id AS "Context_ID", '{P}' AS pipeline
    FROM (SELECT * FROM association WHERE context_id IN (SELECT context_id FROM parentcontext WHERE parent_context_id = {_PID})) a JOIN ({NAMED}) p ON p.execution_id = a.execution_id""")
def _(s: MetadataStore) -> DataFrame:
    return catalog.execution_ids(s, P)


@query("flt35_uuid_prefix", f"SELECT execution_id AS id, string_value AS \"Execution_uuid\" FROM executionproperty WHERE name = 'Execution_uuid' AND execution_id IN ({_RUNS}) AND substring(string_value, 1, 2) = 'a1' AND substring(string_value, 1, 4) = (SELECT min(substring(string_value, 1, 4)) FROM executionproperty WHERE name = 'Execution_uuid' AND execution_id IN ({_RUNS}) AND substring(string_value, 1, 2) = 'a1')")
def _(s: MetadataStore) -> DataFrame:
    four = catalog.execution_ids(s, P).where(F.substring("Execution_uuid", 1, 2) == "a1").agg(F.min(F.substring("Execution_uuid", 1, 4))).first()[0]
    return catalog.executions_by_uuid_prefix(s, P, four or "")


@query("jon11_artifacts_of_execution", "SELECT a.id, t.name AS type, CASE WHEN e.type = 3 THEN 'INPUT' ELSE 'OUTPUT' END AS event FROM event e JOIN artifact a ON e.artifact_id = a.id JOIN type t ON a.type_id = t.id WHERE e.execution_id = 33")
def _(s: MetadataStore) -> DataFrame:
    return _columns(catalog.artifacts_of_execution(s, 33), "id", "type", "event")


_CHAIN = """SELECT e.artifact_id, e.execution_id, CASE WHEN e.type = 3 THEN 'INPUT' ELSE 'OUTPUT' END AS event, c.name AS stage, p.name AS pipeline
    FROM event e JOIN association x ON e.execution_id = x.execution_id JOIN context c ON x.context_id = c.id JOIN parentcontext pc ON pc.context_id = c.id JOIN context p ON p.id = pc.parent_context_id"""


@query("jon12_executions_of_artifact", f"{_CHAIN} WHERE e.artifact_id = 17")
def _(s: MetadataStore) -> DataFrame:
    return catalog.executions_of_artifact(s, s.artifact.where("id = 17").select("name").first()[0])


@query("jon13_executions_of_artifacts", _CHAIN)
def _(s: MetadataStore) -> DataFrame:
    return catalog.executions_of_artifacts(s, s.artifact.select("id"))


@query("jon14_artifacts_of_executions", "SELECT DISTINCT a.id, a.name, t.name AS type FROM event JOIN artifact a ON a.id = artifact_id JOIN type t ON t.id = a.type_id")
def _(s: MetadataStore) -> DataFrame:
    return catalog.artifacts_of_executions(s, s.execution.select("id")).select("id", "name", "type")


@query("agg08_artifacts_by_type", "SELECT t.name AS type, a.id, a.name FROM artifact a JOIN type t ON a.type_id = t.id")
def _(s: MetadataStore) -> DataFrame:
    return catalog.artifacts_by_type(s)


_JSON = """SELECT artifact_id, '[' || string_agg('{"name":"' || name || '","value":"' || coalesce(string_value, int_value::VARCHAR) || '"}', ',' ORDER BY name) || ']' AS artifact_properties FROM artifactproperty GROUP BY 1"""


@query("jon09_artifacts_with_properties", f"SELECT a.id AS artifact_id, a.name, a.create_time_since_epoch, j.artifact_properties FROM artifact a LEFT JOIN ({_JSON}) j ON j.artifact_id = a.id WHERE a.type_id = 11 AND a.id IN (SELECT artifact_id FROM event WHERE execution_id IN (SELECT execution_id FROM association WHERE context_id = {_STAGE}))")
def _(s: MetadataStore) -> DataFrame:
    return browse.found_artifacts(s, P, S, "Dataset")


@query("agg07_label_links", "SELECT DISTINCT 'l' || type_id AS name, CASE WHEN id % 3 > 0 THEN 'h' || (id % 5) END AS hash FROM artifact UNION SELECT 'all', NULL")
def _(s: MetadataStore) -> DataFrame:
    one = F.concat(F.lit("l"), "type_id", F.when(F.col("id") % 3 > 0, F.concat(F.lit(":h"), F.col("id") % 5)).otherwise(""))
    labels = s.artifact.select(F.col("id").alias("artifact_id"), F.lit("labels").alias("name"), F.concat(one, F.lit(",all")).alias("string_value"))
    return catalog.label_links(labels.unionByName(labels.withColumn("string_value", F.lit(None).cast("string")).limit(1)))


@query("srt04_page_totals", f"SELECT count(*)::BIGINT AS total_items, 1 AS page FROM artifact a WHERE a.type_id = 11 AND a.id IN (SELECT artifact_id FROM event WHERE execution_id IN (SELECT execution_id FROM association WHERE context_id = {_STAGE})) UNION ALL SELECT 0, 2")
def _(s: MetadataStore) -> DataFrame:
    """A page beyond the last counts 0 items, though earlier pages have some."""
    found = browse.browse(s, P, S, "Dataset"), browse.browse(s, P, S, "Dataset", Page(1_000_000, 20))
    return s.spark.createDataFrame([(p["total_items"], k) for k, p in enumerate(found, 1)], "total_items long, page int")


@query("srt05_default_page", f"SELECT id AS artifact_id, row_number() OVER (ORDER BY lower(name), id) AS place FROM (SELECT * FROM artifact a WHERE a.type_id = 11 AND a.id IN (SELECT artifact_id FROM event WHERE execution_id IN (SELECT execution_id FROM association WHERE context_id = {_STAGE})) ORDER BY lower(name), id LIMIT 5)")
def _(s: MetadataStore) -> DataFrame:
    """The default request, with the places of its rows, so that their order is compared."""
    items = browse.browse(s, P, S, "Dataset")["items"]
    return s.spark.createDataFrame([(r["artifact_id"], k) for k, r in enumerate(items, 1)], "artifact_id long, place long")


@query("srt06_ordered_stages", f"SELECT stage_name, row_number() OVER (ORDER BY stage_name) AS place FROM (SELECT DISTINCT string_value AS stage_name FROM executionproperty WHERE name = 'Context_Type' AND execution_id IN ({_RUNS}))")
def _(s: MetadataStore) -> DataFrame:
    names = [r.stage_name for r in browse.stages(s, P).collect()]  # a pipeline's stages
    return s.spark.createDataFrame([(n, k) for k, n in enumerate(names, 1)], "stage_name string, place long")


@query("agg09_latest_by_command", "SELECT string_value AS command, max(execution_id) AS execution_id FROM executionproperty WHERE name = 'Execution' GROUP BY 1")
def _(s: MetadataStore) -> DataFrame:
    return catalog.latest_by_command(s)


@query("jon18_reusable_executions", "SELECT c.command, max(execution_id) AS execution_id FROM (VALUES ('python run.py 7'), ('python run.py 8'), ('make all')) AS c(command) LEFT JOIN executionproperty p ON p.name = 'Execution' AND p.string_value = c.command GROUP BY 1")
def _(s: MetadataStore) -> DataFrame:
    commands = s.spark.createDataFrame([("python run.py 7",), ("python run.py 8",), ("make all",)], "command string")
    return catalog.reusable_executions(s, commands)


@query("agg16_contexts_of_artifacts", "SELECT artifact_id, string_agg(DISTINCT c.name, ', ' ORDER BY c.name) AS contexts FROM attribution JOIN context c ON c.id = context_id GROUP BY 1")
def _(s: MetadataStore) -> DataFrame:
    return catalog.pipelines_of_artifacts(s)


@query("snk07_push_plan", "SELECT DISTINCT split_part(a.name, ':', 1) || '.dvc' AS file FROM artifact a JOIN type t ON a.type_id = t.id WHERE t.name <> 'Metrics'")
def _(s: MetadataStore) -> DataFrame:
    return catalog.push_plan(s)


@query("snk08_pull_plan", "SELECT a.name, arg_max(p.string_value, a.id) AS url FROM artifact a JOIN type t ON a.type_id = t.id JOIN artifactproperty p ON p.artifact_id = a.id AND p.name = 'url' WHERE t.name <> 'Label' GROUP BY 1")
def _(s: MetadataStore) -> DataFrame:
    return catalog.pull_plan(s)


# Browsing.
_IN_STAGE = f"SELECT DISTINCT execution_id FROM executionproperty WHERE name = 'Context_Type' AND string_value = '{S}' AND execution_id IN ({_RUNS})"
_CREATED = f"SELECT execution_id, max(TRY_CAST(string_value AS DOUBLE)) AS create_time FROM executionproperty WHERE name = 'original_create_time_since_epoch' AND execution_id IN ({_IN_STAGE}) GROUP BY 1"
_TOUCHED = f"SELECT DISTINCT artifact_id FROM event WHERE execution_id IN ({_IN_STAGE})"
_FOUND = f"SELECT a.id AS artifact_id, a.name, a.create_time_since_epoch FROM artifact a JOIN type t ON a.type_id = t.id WHERE t.name = 'Dataset' AND a.id IN ({_TOUCHED})"


@query("api01_stages", f"SELECT DISTINCT string_value AS stage_name FROM executionproperty WHERE name = 'Context_Type' AND execution_id IN ({_RUNS})")
def _(s: MetadataStore) -> DataFrame:
    return browse.stages(s, P)


@query("api01_artifact_types", f"SELECT DISTINCT t.name AS artifact_type FROM artifact a JOIN type t ON a.type_id = t.id WHERE a.id IN ({_TOUCHED}) AND t.name <> 'Environment'")
def _(s: MetadataStore) -> DataFrame:
    return browse.artifact_types(s, P, S)


@query("srt01_executions_page", f"SELECT s.execution_id, c.create_time FROM ({_IN_STAGE}) s LEFT JOIN ({_CREATED}) c ON s.execution_id = c.execution_id ORDER BY c.create_time DESC NULLS LAST, s.execution_id LIMIT 20 OFFSET 20")
def _(s: MetadataStore) -> DataFrame:
    return browse.executions_page(s, P, S, Page(2, 20, descending=True)).select("execution_id", "create_time")


_DEEP = "(SELECT count(*) * 3 // 5 FROM execution)"


@query("srt03_deep_page", f"SELECT id, last_known_state AS state FROM execution ORDER BY last_known_state DESC NULLS LAST, id LIMIT 20 OFFSET {_DEEP}")
def _(s: MetadataStore) -> DataFrame:
    """Three fifths down all executions by state, of which there are three: ranges of the key, then of the ids of one key."""
    rows = s.execution.select(F.col("last_known_state").alias("state"), "id")
    return paging.seek(rows, "state", "id", s.execution.count() * 3 // 5, 20, descending=True, direct=1000)


@query("srt03_deep_names", f"SELECT lower(name) AS name, id FROM artifact ORDER BY lower(name) NULLS LAST, id LIMIT 500 OFFSET (SELECT count(*) * 3 // 5 FROM artifact)")
def _(s: MetadataStore) -> DataFrame:
    return paging.seek(s.artifact.select(F.lower("name").alias("name"), "id"), "name", "id", s.artifact.count() * 3 // 5, 500, direct=100)


@query("flt28_search_executions", f"""SELECT s.execution_id, c.create_time FROM ({_IN_STAGE}) s LEFT JOIN ({_CREATED}) c ON s.execution_id = c.execution_id
    LEFT JOIN (SELECT execution_id, string_agg(name || {_TEXT}, ' ' ORDER BY name) AS props FROM executionproperty GROUP BY 1) p ON p.execution_id = s.execution_id
    WHERE concat(p.props, strftime(make_timestamp((c.create_time * 1000)::BIGINT), '%-m/%-d/%Y')) ILIKE '%1-URGENT%' OR strftime(make_timestamp((c.create_time * 1000)::BIGINT), '%-m/%-d/%Y') ILIKE '%1-URGENT%'""")
def _(s: MetadataStore) -> DataFrame:
    return browse.found_executions(s, P, S, "1-urgent").select("execution_id", "create_time")


@query("flt28_search_by_index", f"""SELECT x.execution_id FROM (SELECT execution_id, string_agg(name || {_TEXT}, ' ' ORDER BY name) AS props FROM executionproperty GROUP BY 1) x
    WHERE props ILIKE '%3-MED%NOT SPEC%' OR (props ILIKE '%1-URGENT%' AND execution_id IN ({_RUNS}))""")
def _(s: MetadataStore) -> DataFrame:
    """An index over all executions, made from those that a pipeline has and kept up with all others; two searches among its candidates, verified."""
    index = search.Index(s.spark, scratch_path(s.spark, "index"))
    mine = browse.pipeline_executions(s, P).select("id")
    others = s.execution.select("id").join(mine.hint("merge"), "id", "left_anti")
    for ids in (mine, others):
        index.update(search.execution_texts(s, ids.withColumnRenamed("id", "execution_id")))
    found = None
    for pattern, among in (("3-med%not spec", None), ("1-urgent", mine)):
        rows = index.found(pattern, among)
        found = rows if found is None else found.unionByName(rows)
    return found.select(F.col("id").alias("execution_id")).distinct()


@query("srt02_artifacts_page", f"SELECT * FROM ({_FOUND}) f ORDER BY lower(name), artifact_id LIMIT 20")
def _(s: MetadataStore) -> DataFrame:
    return browse.artifacts_page(s, P, S, "Dataset", Page(1, 20)).drop("artifact_properties")


@query("srt02_artifacts_page_by_time", f"SELECT * FROM ({_FOUND}) f ORDER BY create_time_since_epoch DESC NULLS FIRST, artifact_id LIMIT 5 OFFSET 5")
def _(s: MetadataStore) -> DataFrame:
    return browse.artifacts_page(s, P, S, "Dataset", Page(2, 5, sort_column="create_time", descending=True)).drop("artifact_properties")


@query("flt29_search_artifacts", f"SELECT * FROM ({_FOUND}) f WHERE concat(artifact_id, name) ILIKE '%bolt:%' OR strftime(make_timestamp(create_time_since_epoch * 1000), '%Y-%m-%d %H:%M:%S%-m/%-d/%Y%Y%-m%-d') ILIKE '%bolt:%'")
def _(s: MetadataStore) -> DataFrame:
    return browse.found_artifacts(s, P, S, "Dataset", "BOLT:").drop("artifact_properties")


@query("flt29_search_dates", f"SELECT * FROM ({_FOUND}) f WHERE concat(artifact_id, name, strftime(make_timestamp(create_time_since_epoch * 1000), '%Y-%m-%d %H:%M:%S%-m/%-d/%Y%Y%-m%-d')) ILIKE '%2001-10%'")
def _(s: MetadataStore) -> DataFrame:
    return browse.found_artifacts(s, P, S, "Dataset", "2001-10").drop("artifact_properties")


@query("win02_total_records", f"SELECT count(*) AS total_records FROM ({_FOUND}) f")
def _(s: MetadataStore) -> DataFrame:
    return browse.total(browse.found_artifacts(s, P, S, "Dataset"))


@query("win01_total_records", f"SELECT count(*) AS total_records FROM ({_IN_STAGE}) f")
def _(s: MetadataStore) -> DataFrame:
    return browse.total(browse.found_executions(s, P, S))


@query("agg02_artifact_properties", """SELECT artifact_id, '[' || string_agg('{"name":"' || name || '","value":"' || coalesce(string_value, int_value::VARCHAR) || '"}', ',' ORDER BY name) || ']' AS artifact_properties FROM artifactproperty GROUP BY 1""")
def _(s: MetadataStore) -> DataFrame:
    return values.property_json(s.artifactproperty, "artifact_id", "artifact_properties")


@query("agg01_execution_properties", f"""SELECT execution_id, '[' || string_agg('{{"name":"' || name || '","value":"' || {_TEXT} || '"}}', ',' ORDER BY name) || ']' AS execution_properties FROM executionproperty GROUP BY 1""")
def _(s: MetadataStore) -> DataFrame:
    return values.property_json(s.executionproperty, "execution_id", "execution_properties")


@query("agg03_create_time", "SELECT execution_id, max(TRY_CAST(string_value AS DOUBLE)) AS create_time FROM executionproperty WHERE name = 'original_create_time_since_epoch' GROUP BY 1")
def _(s: MetadataStore) -> DataFrame:
    rows = s.executionproperty.where(F.col("name") == "original_create_time_since_epoch")
    return rows.groupBy("execution_id").agg(F.max(values.as_number()).alias("create_time"))


@query("agg05_stage_count", f"SELECT count(*) AS n FROM context JOIN parentcontext ON id = context_id WHERE parent_context_id = {_PID}")
def _(s: MetadataStore) -> DataFrame:
    return catalog.stages_of(s, P).agg(F.count("*").alias("n"))


@query("agg_event_directions", "SELECT execution_id, count(*) FILTER (type = 3) AS inputs, count(*) FILTER (type = 4) AS outputs FROM event GROUP BY 1")
def _(s: MetadataStore) -> DataFrame:
    return catalog.events_by_direction(s)


@query("agg04_distinct_types", "SELECT DISTINCT type_id::BIGINT AS type_id FROM artifact")
def _(s: MetadataStore) -> DataFrame:
    return s.artifact.select("type_id").distinct()


# Scalar functions over the store's names.
@query("str05_short_names", """SELECT a.id, CASE t.name WHEN 'Metrics' THEN CASE WHEN len(string_split(a.name, ':')) >= 3 THEN split_part(a.name, ':', 1) || ':' || substring(split_part(a.name, ':', 2), 1, 4) || ':' || split_part(a.name, ':', 3) ELSE a.name END
    WHEN 'Model' THEN CASE WHEN len(string_split(a.name, ':')) >= 3 THEN split_part(split_part(a.name, ':', -3), '/', -1) || ':' || substring(split_part(a.name, ':', -2), 1, 4) ELSE a.name END
    WHEN 'Dataset' THEN split_part(split_part(a.name, ':', 1), '/', -1) || ':' || substring(split_part(a.name, ':', -1), 1, 4) ELSE a.name END AS short
    FROM artifact a JOIN type t ON a.type_id = t.id""")
def _(s: MetadataStore) -> DataFrame:
    return catalog.with_type(s, s.artifact).select("id", names.short_artifact("name", "type").alias("short"))


@query("str08_pipeline_url", """SELECT artifact_id, CASE WHEN contains(string_value, 'EUROPE') THEN split_part(string_value, 'EUROPE:', 2) END AS url FROM artifactproperty WHERE name = 'url'""")
def _(s: MetadataStore) -> DataFrame:
    urls = s.artifactproperty.where(F.col("name") == "url")
    return urls.select("artifact_id", names.pipeline_url("string_value", F.lit("EUROPE")).alias("url"))


@query("str09_object_path", """SELECT artifact_id, 'files/md5/' || substring(md5(artifact_id::VARCHAR), 1, 2) || '/' || substring(md5(artifact_id::VARCHAR), 3) AS object, 'store' AS bucket, substring(md5(artifact_id::VARCHAR), 1, 2) || '/' || substring(md5(artifact_id::VARCHAR), 3) AS key FROM artifactproperty WHERE name = 'url'""")
def _(s: MetadataStore) -> DataFrame:
    urls = s.artifactproperty.where(F.col("name") == "url").withColumn("u", names.pipeline_url("string_value", F.lit("ASIA")))
    return urls.select("artifact_id", names.object_path(F.col("u")).alias("object"), names.bucket_name(F.col("u")).alias("bucket"), names.content_key(F.md5(F.col("artifact_id").cast("string"))).alias("key"))


@query("str10_cached_urls", "SELECT artifact_id, 'https://cache.example.org:8443/files/' || artifact_id || '.bin' AS cached, 'origin.example.com' AS host, '' AS none FROM (SELECT id AS artifact_id FROM artifact)")
def _(s: MetadataStore) -> DataFrame:
    """STR10, STR11."""
    url = F.concat(F.lit("osdf://User@Origin.Example.com:1094/files/"), "id", F.lit(".bin?x=1"))
    return s.artifact.select(F.col("id").alias("artifact_id"), names.cached_url(url, F.lit("https://cache.example.org:8443/other")).alias("cached"), names.host_name(url).alias("host"), names.host_name(F.lit("no url")).alias("none"))


@query("str17_renamed_keys", f"SELECT artifact_id, 'kind=' || max(string_value) FILTER (name = 'kind') || ';x_size=' || max(int_value) FILTER (name = 'size') || ';address=' || max(string_value) FILTER (name = 'url') AS properties FROM artifactproperty GROUP BY 1")
def _(s: MetadataStore) -> DataFrame:
    m = values.property_map(s.artifactproperty, "artifact_id", rename={"kind": "kind", "url": "address"}, prefix="x_", on_clash="raise")
    cell = lambda k: F.concat(F.lit(f"{k}="), F.col("properties")[k])
    return m.select("artifact_id", F.concat_ws(";", *map(cell, ("kind", "x_size", "address"))).alias("properties"))


@query("map01_user_type", "SELECT id, CASE WHEN id % 2 = 0 THEN 'type' END AS plain, 'user_type' AS custom FROM artifact")
def _(s: MetadataStore) -> DataFrame:
    """MAP01: only a custom property named type is renamed."""
    row = lambda custom: s.artifact.where(F.lit(custom) | (F.col("id") % 2 == 0)).select(F.col("id").alias("artifact_id"), F.lit("type").alias("name"), F.lit(custom).alias("is_custom_property"), F.lit("v").alias("string_value"))
    props = s.artifactproperty.limit(0).unionByName(row(True).unionByName(row(False)), allowMissingColumns=True)
    return export.property_maps(props, "artifact_id").select("id", F.get(F.map_keys("properties"), F.lit(0)).alias("plain"), F.get(F.map_keys("custom_properties"), F.lit(0)).alias("custom"))


@query("dat07_local_times", """SELECT id, ms, CASE WHEN id % 3 = 0 THEN 1439 WHEN id % 3 = 1 THEN 65 END AS minutes, CASE WHEN id % 2 = 0 THEN 'Asia/Kolkata' ELSE 'UTC' END AS zone
    FROM (SELECT id, epoch_us(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (id % 100000) MINUTE - INTERVAL 330 MINUTE) // 1000 AS ms FROM execution)""")
def _(s: MetadataStore) -> DataFrame:
    """DAT06, DAT07."""
    local = F.date_format(F.timestamp_seconds(F.lit(1704067200) + (F.col("id") % 100000) * 60), "yyyy-MM-dd'T'HH:mm:ss")
    clock = F.when(F.col("id") % 3 == 0, "23:59").when(F.col("id") % 3 == 1, "1:05").otherwise("24:00")
    zone = F.when(F.col("id") % 2 == 0, "Asia/Kolkata").otherwise("nowhere at all")
    return s.execution.select("id", times.to_utc_ms(local, F.lit("Asia/Kolkata")).alias("ms"), times.minutes_of(clock).alias("minutes"), times.known_zone(zone).alias("zone"))


@query("str12_clean_keys", "SELECT id, regexp_replace(replace(name, '-', '_'), '[^A-Za-z0-9_]+', '', 'g') AS key FROM artifact")
def _(s: MetadataStore) -> DataFrame:
    return s.artifact.select("id", names.clean_key(F.col("name")).alias("key"))


@query("dat02_search_tokens", "SELECT id, strftime(make_timestamp(create_time_since_epoch * 1000), '%Y-%m-%d %H:%M:%S') AS a, strftime(make_timestamp(create_time_since_epoch * 1000), '%-m/%-d/%Y') AS b, strftime(make_timestamp(create_time_since_epoch * 1000), '%a %d %b %Y %H:%M:%S GMT') AS c FROM execution")
def _(s: MetadataStore) -> DataFrame:
    t = times.search_tokens(F.col("create_time_since_epoch"))
    return s.execution.select("id", t[0].alias("a"), t[1].alias("b"), times.display(F.col("create_time_since_epoch")).alias("c"))


@query("str21_execution_labels", f"SELECT execution_id AS id, substring(kind, strpos(kind, '/') + 1) || '_' || substring(uuid, 1, 4) AS name FROM ({NAMED}) p")
def _(s: MetadataStore) -> DataFrame:
    rows = values.property_pivot(s.executionproperty, "execution_id", ["Context_Type", "Execution_uuid"])
    return rows.select(F.col("execution_id").alias("id"), names.execution_label("Context_Type", "Execution_uuid").alias("name"))
