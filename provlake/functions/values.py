"""Typed property values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_text(prefix: str = "") -> Column:
    """STR01: a property's value as text: string, bool, double, int, bytes, proto, else the text NULL, in that order."""
    c = lambda n: F.col(f"{prefix}{n}")
    return F.coalesce(c("string_value"), c("bool_value").cast("string"), c("double_value").cast("string"), c("int_value").cast("string"), c("byte_value").cast("string"), c("proto_value").cast("string"), F.lit("NULL"))


def as_number() -> Column:
    """A property's value as double, null where it isn't a number; garbage in strings is null, not an error (CST01)."""
    return F.coalesce(F.col("double_value"), F.col("int_value").cast("double"), F.expr("try_cast(string_value as double)"))


def typed(value: str) -> Column:
    """A text value as a typed one, for writing: struct of int_value, double_value, bool_value and string_value, one of them set."""
    v = F.col(value)
    whole = F.expr(f"try_cast({value} as bigint)")
    real = F.expr(f"try_cast({value} as double)")
    flag = F.when(F.lower(v).isin("true", "false"), F.lower(v) == "true")
    is_whole = v.rlike(r"^[+-]?\d+$") & whole.isNotNull()
    is_real = ~is_whole & v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & real.isNotNull()
    return F.struct(F.when(is_whole, whole).alias("int_value"), F.when(is_real, real).alias("double_value"), flag.alias("bool_value"), F.when(~is_whole & ~is_real & flag.isNull(), v).alias("string_value"))


def infer_metric(value: str) -> Column:
    """STR16: the kind of a metric's text: int, float, list (comma-separated) or string."""
    v = F.trim(F.col(value))
    return F.when(v.rlike(r"^[+-]?\d+$"), "int").when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "float").when(v.contains(","), "list").otherwise("string")


def property_map(props: DataFrame, key: str, rename: dict[str, str] | None = None, prefix: str = "custom_properties_", on_clash: str = "last") -> DataFrame:
    """STR17: one row for each entity: a map from property name to text.

    rename: new names of some properties; prefix: what custom properties' names begin with. Two properties of an entity
    that end up with one name: the larger text stays, or with on_clash="raise" that is an error.

    Only names and texts travel, once, as rows of their own, so that tasks are cut by what they are to sort: a grouping before
    that would sort all that a task reads.
    """
    if on_clash not in ("last", "raise"):
        raise ValueError(f"on_clash is last or raise, not {on_clash!r}")
    old = F.when(F.col("is_custom_property"), F.concat(F.lit(prefix), "name")).otherwise(F.col("name"))
    name = F.coalesce(F.create_map(*(F.lit(x) for kv in rename.items() for x in kv))[F.col("name")], old) if rename else old
    props = props.select(key, F.struct(name.alias("key"), as_text().alias("value")).alias("entry")).hint("rebalance", key)
    entries = F.array_sort(F.collect_set("entry"))
    if on_clash == "raise":
        clash = F.size(F.array_distinct(F.transform("entries", lambda e: e["key"]))) < F.size("entries")
        rows = props.groupBy(key).agg(entries.alias("entries"))
        return rows.select(key, F.when(clash, F.raise_error(F.lit("two properties have one name"))).otherwise(F.map_from_entries("entries")).alias("properties"))
    last = F.filter(entries, lambda e: e["key"].isNotNull())
    rows = props.groupBy(key).agg(last.alias("entries"))
    kept = F.filter("entries", lambda e, i: F.coalesce(F.get("entries", i + 1)["key"] != e["key"], F.lit(True)))
    return rows.select(key, F.map_from_entries(kept).alias("properties"))


def property_pivot(props: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row for each entity, one text column for each named property. The names are pushed down before the grouping."""
    picked = props.where(F.col("name").isin(names))
    return picked.groupBy(key).agg(*(F.max(F.when(F.col("name") == n, as_text())).alias(n) for n in names))


def properties_json() -> Column:
    """AGG01, AGG02: an entity's properties as a JSON array of {name, value}, sorted by name; an aggregate."""
    return F.to_json(F.array_sort(F.collect_list(F.struct("name", as_text().alias("value")))))


def property_json(props: DataFrame, key: str, out: str) -> DataFrame:
    """AGG01, AGG02: one row for each entity with its properties_json()."""
    return props.groupBy(key).agg(properties_json().alias(out))
