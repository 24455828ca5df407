"""The index of known uuids beside merges without it."""

import pytest

from provlake import MetadataStore
from provlake.checkpoint import scratch_path
from provlake.operators import known, merge

PROPS = "execution_id long, name string, string_value string"


def store_of(spark, lists):
    rows = spark.createDataFrame([(i, "Execution_uuid", u) for i, u in enumerate(lists)], PROPS)
    return MetadataStore(spark, {"executionproperty": rows})


@pytest.fixture
def store(spark):
    return store_of(spark, [f"u{i},c{i}" if i % 3 else f"u{i}" for i in range(200)] + [None, "", "u1"])


INCOMING = [(1, "", "u1"), (2, "", "new1"), (3, "", "u2,new2"), (4, "named", "u3"), (5, None, None), (6, "", ""), (7, "", "u4,c4"), (8, None, "c3"), (None, "", "new3"), (9, "", "u5,u5")]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("words", [1024, 1])
def test_same_as_without(spark, store, words, monkeypatch):
    """A filter of 64 bits rules nothing out, and the result stays."""
    monkeypatch.setattr(known, "WORDS", words)
    monkeypatch.setattr(known, "BUCKETS", 8)
    incoming = spark.createDataFrame(INCOMING, "id long, name string, uuids string")
    index = known.KnownUuids(spark, scratch_path(spark, "uuids"))
    assert rows(index.new_executions(incoming)) == rows(incoming.where("id is not null and (uuids is not null or name = 'named')"))
    index.add_store(store)
    index.add_store(store)
    assert rows(index.new_executions(incoming)) == rows(merge.new_executions(store, incoming))
    parts = incoming.selectExpr("explode(split(uuids, ',')) as uuid")
    assert rows(index.known(parts)[0]) == rows(merge.known_uuids(store, parts))


def test_a_push_reads_few_buckets(spark, store):
    index = known.KnownUuids(spark, scratch_path(spark, "uuids"))
    index.add_store(store)
    fresh = spark.createDataFrame([(f"fresh{i}",) for i in range(300)], "uuid string")
    found, touched = index.known(fresh.union(spark.createDataFrame([("u7",), ("u7",), (None,)], "uuid string")))
    assert [r.uuid for r in found.collect()] == ["u7"] and len(touched) <= 5
    before = index.manifest()
    index.add(spark.createDataFrame([("one more",)], "uuid string"))
    after = index.manifest()
    assert sum(after["uuids"][b] != before["uuids"].get(b) for b in after["uuids"]) == 1
