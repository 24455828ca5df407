"""A table that several writers keep at once, beside a plain replay."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from provlake.checkpoint import scratch_path
from provlake.operators.buckets import Conflict
from provlake.streaming import sync, upserts

SCHEMA = "k string, at long, v string, bucket int"


def replay(batches):
    best = {}
    for k, at, v, b in (row for batch in batches for row in batch):
        new = (-1 if at is None else at, v or "", b or 0)
        if k not in best or new > best[k]:
            best[k] = new
    return sorted((k or "", *x) for k, x in best.items())


def rows(table):
    return sorted((r.k or "", -1 if r.at is None else r.at, r.v or "", r.bucket or 0) for r in table.rows().collect())


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(upserts, "BUCKETS", 4)
    monkeypatch.setattr(upserts, "KEEP", 4)


def test_writers_at_once_lose_nothing(spark, few):
    """Every (key, at) is written once, so the order of commits doesn't matter to the result."""
    path, r = scratch_path(spark, "upserts"), random.Random(8)
    batches = {w: [[(f"k{r.randrange(30)}", 1000 * w + 10 * i + j, f"{w}.{i}.{j}", j) for j in range(4)] for i in range(4)] for w in range(3)}

    def write(w):
        table = upserts.Upserts(spark, path, SCHEMA, ["k"], "at")
        for i, batch in enumerate(batches[w]):
            table.upsert(spark.createDataFrame(batch, SCHEMA), f"writer {w}", i)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, batches))
    table = upserts.Upserts(spark, path, SCHEMA, ["k"], "at")
    assert rows(table) == replay(b for w in batches.values() for b in w)
    now = table.manifest()
    assert now["version"] == 12 and now["writers"] == {f"writer {w}": 3 for w in range(3)}
    assert len(table._found("manifest-*.json")) <= 2 * upserts.KEEP
    assert len(table._found("rows/version=*/*=*")) <= 2 * upserts.KEEP * upserts.BUCKETS
    table.vacuum()
    assert rows(table) == replay(b for w in batches.values() for b in w)
    assert len(table._found("manifest-*.json")) == 1 and len(table._found("rows/version=*/*=*")) == len(now["rows"])


def test_odd_rows_and_repeated_batches(spark, few):
    table = upserts.Upserts(spark, scratch_path(spark, "upserts"), SCHEMA, ["k"], "at")
    frame = lambda batch: spark.createDataFrame(batch, SCHEMA)
    assert table.rows().count() == 0 and table.upsert(frame([]), "a", 0)["version"] == 0
    first = [("x", 5, "a", 1), ("x", 5, "b", None), ("", None, None, None), (None, 1, "null key", 2), ("x", None, "z", 3)]
    table.upsert(frame(first), "a", 1)
    assert rows(table) == [("", -1, "", 0), ("", 1, "null key", 2), ("x", 5, "b", 0)]
    table.upsert(frame([("x", 4, "older", 0), ("y", 1, "y", 0)]), "b", 1)
    version = table.upsert(frame([("x", 9, "repeated", 0)]), "a", 1)["version"]
    assert version == 2 and ("x", 5, "b", 0) in rows(table)
    table.upsert(frame([("x", 5, "a tie: the later one stays", 0)]), "a", 2)
    assert ("x", 5, "a tie: the later one stays", 0) in rows(table)


def test_files_of_a_loser_are_used_where_nothing_of_it_changed(spark, few, monkeypatch):
    table = upserts.Upserts(spark, scratch_path(spark, "upserts"), SCHEMA, ["k"], "at")
    one = {}
    for i in range(100):
        k = f"k{i}"
        (b,) = spark.createDataFrame([(k,)], "k string").select(upserts.bucket_of("k", 4)).first()
        one.setdefault(b, k)
        if len(one) > 1:
            break
    (mine, other), written = list(one.values()), []
    plain, put = table.write, table._put

    def write(old, changed):
        written.append(old["version"])
        return plain(old, changed)

    def slow(key):
        def interfere(aside, place):
            monkeypatch.setattr(table, "_put", put)
            upserts.Upserts(spark, table.path, SCHEMA, ["k"], "at").upsert(spark.createDataFrame([(key, 1, "other", 0)], SCHEMA), "other", table.manifest()["version"])
            return put(aside, place)

        monkeypatch.setattr(table, "_put", interfere)

    monkeypatch.setattr(table, "write", write)
    slow(other)
    table.upsert(spark.createDataFrame([(mine, 2, "mine", 0)], SCHEMA), "me", 0)
    assert written == [0] and rows(table) == sorted([(mine, 2, "mine", 0), (other, 1, "other", 0)])
    slow(mine)
    table.upsert(spark.createDataFrame([(mine, 1, "late, and equal in order", 0)], SCHEMA), "me", 1)
    assert written == [0, 2, 3] and (mine, 2, "mine", 0) in rows(table)


def test_a_writer_that_slept_through_a_vacuum_fails(spark, few):
    table = upserts.Upserts(spark, scratch_path(spark, "upserts"), SCHEMA, ["k"], "at")
    frame = lambda i: spark.createDataFrame([(f"k{i}", i, "v", 0)], SCHEMA)
    table.upsert(frame(0))
    old = table.manifest()
    written = table.write(old, {"rows": ([], spark.createDataFrame([], table.kinds["rows"]))})
    for i in range(1, 4):
        table.upsert(frame(i))
    with pytest.raises(Conflict, match="taken"):
        table.publish(old, written)
    table.vacuum()
    with pytest.raises(Conflict, match="past"):
        table.publish(old, written)
    assert [r[0] for r in rows(table)] == ["k0", "k1", "k2", "k3"] and len(table._found("manifest-*.json")) == 1


def test_two_streams_into_one_table(spark, tmp_path, few):
    """Both streams end, start again with more files, and the table is that of a plain replay."""
    batches = {w: [[(f"k{(i + j) % 7}", 100 * i + 10 * w + j, f"{w}{i}", j) for j in range(5)] for i in range(3)] for w in range(2)}
    target = f"file://{tmp_path}/table"
    for upto in (2, 3):
        streams = []
        for w, all_of in batches.items():
            for batch in all_of[upto - 2 : upto] if upto == 2 else all_of[2:]:
                spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{w}")
            streams.append(sync.upsert_stream(spark, f"{tmp_path}/in{w}", spark.createDataFrame([], SCHEMA).schema, target, ["k"], "at", f"{tmp_path}/checkpoint{w}"))
        for s in streams:
            s.awaitTermination()
        got = sorted((r.k, r.at, r.v, r.bucket) for r in sync.read_upserts(spark, target, spark.createDataFrame([], SCHEMA).schema).collect())
        assert got == replay(b for w in batches.values() for b in w[:upto])
