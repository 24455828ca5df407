"""Property maps of many entities."""

import pytest

from provlake.functions import values
from provlake.operators import catalog
from provlake.plans import adapter


def test_properties_are_dealt_before_they_are_grouped(spark, data):
    """flt11: a task groups the property rows that it was dealt, not all that come of what a join or a scan gave it."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = adapter.load(spark, data)
        found = catalog.executions_by_ids(store, store.execution.select("id"))
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        (first,) = [i for i, line in enumerate(plan) if "partial_collect_set" in line]
        assert "Exchange hashpartitioning(execution_id" in plan[first + 1], plan[first + 1]
        assert found.count() == store.execution.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_names_that_clash_and_missing_names(spark):
    rows = [(1, "a", False, "x"), (1, "a", False, "y"), (1, "a", True, "z"), (1, None, False, "n"), (2, None, False, "n"), (2, "b", None, None), (None, "a", False, "x")]
    props = spark.createDataFrame(rows, "id long, name string, is_custom_property boolean, string_value string").selectExpr(
        "*", "cast(null as long) int_value", "cast(null as double) double_value", "cast(null as binary) byte_value", "cast(null as binary) proto_value", "cast(null as boolean) bool_value"
    )
    got = {r.id: r.properties for r in values.property_map(props, "id").collect()}
    assert got == {1: {"a": "y", "custom_properties_a": "z"}, 2: {"b": "NULL"}, None: {"a": "x"}}
    with pytest.raises(Exception, match="two properties have one name"):
        values.property_map(props, "id", on_clash="raise").collect()


def test_nothing_that_grows_with_the_entities_is_broadcast(spark, data):
    """flt17: files tell little of how large ids and maps of properties are, so only the table of types goes through the driver."""
    store = adapter.load(spark, data)
    frame = catalog.entity_frame(store.artifact.select("id", "name"), store.artifactproperty, "artifact_id", ["kind", "size"])
    for found in (catalog.artifacts_by_ids(store, store.artifact.select("id")), catalog.executions_by_ids(store, store.execution.select("id")), frame):
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        below = [plan[i + 1] for i, line in enumerate(plan) if "BroadcastExchange" in line]
        assert not any("Aggregate" in line or "p_partkey" in line or "o_orderkey" in line for line in below), below
