"""Closures, levels, trees, merges and exports on small graphs, beside plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from provlake.operators import browse, catalog, control, export, lineage, merge, selection
from provlake.schema import CONTROL_TABLES, TABLES
from provlake.sources import files
from provlake.store import MetadataStore
from provlake.streaming import sync


def make(spark, runs, artifacts, events, pipeline="P"):
    """A store: runs (id, stage, uuids), artifacts (id, type, name), events (artifact, run, type)."""
    kinds = sorted({a[1] for a in artifacts})
    stages = sorted({r[1] for r in runs})
    df = lambda t, rows, cols: spark.createDataFrame([tuple(dict(zip(cols, r)).get(f.name) for f in TABLES[t]) for r in rows], TABLES[t])
    props = [(i, "Context_Type", False, s) for i, s, _ in runs] + [(i, "Execution_uuid", False, u) for i, _, u in runs]
    return MetadataStore(
        spark,
        {
            "type": df("type", [(1, "Parent_Context", 2), (2, "Pipeline_Stage", 2), (3, "Run", 0), *((10 + k, n, 1) for k, n in enumerate(kinds))], ["id", "name", "type_kind"]),
            "context": df("context", [(1, 1, pipeline, 5), *((2 + k, 2, s, 5) for k, s in enumerate(stages))], ["id", "type_id", "name", "last_update_time_since_epoch"]),
            "parentcontext": df("parentcontext", [(2 + k, 1) for k in range(len(stages))], ["context_id", "parent_context_id"]),
            "execution": df("execution", [(i, 3, "", 100 * i, 100 * i) for i, _, _ in runs], ["id", "type_id", "name", "create_time_since_epoch", "last_update_time_since_epoch"]),
            "association": df("association", [(i, 2 + stages.index(s), i) for i, s, _ in runs], ["id", "context_id", "execution_id"]),
            "artifact": df("artifact", [(i, 10 + kinds.index(k), f"uri{i}", n) for i, k, n in artifacts], ["id", "type_id", "uri", "name"]),
            "attribution": df("attribution", sorted({(0, 2 + stages.index(next(r[1] for r in runs if r[0] == e[1])), e[0]) for e in events}), ["id", "context_id", "artifact_id"]),
            "event": df("event", [(k, *e) for k, e in enumerate(events, 1)], ["id", "artifact_id", "execution_id", "type"]),
            "executionproperty": df("executionproperty", props, ["execution_id", "name", "is_custom_property", "string_value"]),
        },
    )


@pytest.fixture(scope="module")
def example(spark):
    """Prepare, Featurize, Train, Evaluate, with a label, an environment and a shared output."""
    runs = [(1, "P/Prepare", "aaaa-1"), (2, "P/Featurize", "bbbb-1,bbbb-2"), (3, "P/Train", "cccc-1"), (4, "P/Evaluate", "dddd-1")]
    artifacts = [(1, "Dataset", "a/data.xml.gz:236d95"), (2, "Dataset", "a/train.tsv:11aa"), (3, "Dataset", "a/test.tsv:22bb"), (4, "Dataset", "a/train.pkl:33cc"), (5, "Dataset", "a/test.pkl:44dd"), (6, "Model", "a/model.pkl:55ee:3"), (7, "Metrics", "metrics:66ff:4"), (8, "Environment", "env"), (9, "Label", "label")]
    events = [(1, 1, 3), (8, 1, 3), (9, 1, 3), (2, 1, 4), (3, 1, 4), (2, 2, 3), (3, 2, 3), (4, 2, 4), (5, 2, 4), (4, 3, 3), (6, 3, 4), (6, 4, 3), (5, 4, 3), (7, 4, 4)]
    return make(spark, runs, artifacts, events)


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_example_lineage(example):
    assert ids(lineage.ancestors(example, 6)) == [1, 2, 3, 4, 8, 9]
    assert ids(lineage.descendants(example, 2)) == [4, 5, 6, 7]
    assert ids(lineage.parents(example, 2, lineage_only=True)) == [1]
    assert ids(lineage.ancestor_executions(example, 6)) == [1, 2]
    assert ids(lineage.producer(example, "a/model.pkl:55ee:3")) == [3]
    assert sorted(r[0] for r in lineage.parent_execution_ids(example, 2).collect()) == [1, 1]
    tree = {tuple(r.members): (r.level, list(r.parent_labels)) for r in lineage.execution_tree(example, "P", "dddd").collect()}
    assert tree == {("Prepare_aaaa",): (0, []), ("Featurize_bbbb",): (1, ["Prepare_aaaa"]), ("Train_cccc",): (2, ["Featurize_bbbb"]), ("Evaluate_dddd",): (3, ["Featurize_bbbb", "Train_cccc"])}
    assert lineage.execution_tree(example, "P", "none").count() == 0
    layers = {m: r.level for r in lineage.artifact_tree(example, "P").collect() for m in r.members}
    assert layers == {"data.xml.gz:236d": 0, "train.tsv:11aa": 1, "test.tsv:22bb": 1, "train.pkl:33cc": 2, "test.pkl:44dd": 2, "model.pkl:55ee": 3, "metrics:66ff:4": 4}


def test_model_card(example):
    card = {k: ids(v) for k, v in lineage.model_card(example, 6).items()}
    assert card == {"model": [6], "executions": [3, 4], "inputs": [4, 5], "outputs": [7]}
    assert all(v.count() == 0 for v in lineage.model_card(example, 1).values())


def test_random_graphs(spark):
    rnd = random.Random(1)
    for _ in range(2):
        nodes = list(range(30))
        edges = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(45)}
        df = spark.createDataFrame(sorted(edges), "parent long, child long")
        got = {r.id: r.hops for r in lineage.closure(df, spark.createDataFrame([(0,)], "id long")).collect()}
        want, frontier, hops = {0: 0}, {0}, 0
        while frontier:
            hops += 1
            frontier = {b for a, b in edges if a in frontier} - set(want)
            want |= dict.fromkeys(frontier, hops)
        assert got == want
        level, rest = {}, {n: {a for a, b in edges if b == n} for n in nodes}
        for k in range(40):
            ready = [n for n, up in rest.items() if up <= set(level)]
            if not ready:
                break
            level |= dict.fromkeys(ready, k)
            for n in ready:
                del rest[n]
        got = {r.id: r.level for r in lineage.levels(spark.createDataFrame([(n,) for n in nodes], "id long"), df).collect()}
        assert got == level  # nodes on cycles, and below them, have none


def test_round_trip_and_merge(spark, example):
    nested = export.read_json(export.to_json(export.payload(example)))
    assert export.flat_events(nested).count() == 14
    assert [r.name for r in export.environments(example, "P").collect()] == ["env"]
    other = make(spark, [(1, "P/Train", "cccc-1,cccc-2"), (2, "P/New", "eeee-1")], [(1, "Model", "a/model.pkl:55ee:3"), (2, "Dataset", "b/x:1")], [(1, 1, 4), (2, 2, 4)])
    other.tables["artifact"] = other.artifact.withColumn("uri", F.when(F.col("id") == 1, "uri6").otherwise("uriX"))
    merged = merge.merge_stores(example, other)
    assert (merged.execution.count(), merged.artifact.count(), merged.context.count(), merged.event.count()) == (5, 10, 6, 15)
    uuids = {r.string_value for r in merged.executionproperty.where("name = 'Execution_uuid'").collect()}
    assert "cccc-1,cccc-2" in uuids and "eeee-1" in uuids
    again = merge.merge_stores(merged, other)
    assert all(sorted(map(str, getattr(again, t).collect())) == sorted(map(str, getattr(merged, t).collect())) for t in ("execution", "artifact", "context", "event", "type", "association"))


def test_new_executions(spark, example):
    incoming = spark.createDataFrame([(1, "", "aaaa-1"), (2, "", "bbbb-1,zzzz"), (3, "named", "cccc-1"), (4, "", "new")], "id long, name string, uuids string")
    assert ids(merge.new_executions(example, incoming)) == [2, 3, 4]
    status = lambda rows, p: merge.status(example, rows, p, catalog.pipelines(example)).first()[0]
    assert [status(incoming, "P"), status(incoming.limit(0), "P"), status(incoming, "Q"), status(incoming.withColumn("uuids", F.lit(None).cast("string")), "P")] == ["success", "exists", "pipeline_not_exist", "version_update"]


def test_incremental(example):
    rows = export.payload(example, since=300).select(F.explode("stages").alias("s")).select(F.explode("s.executions").alias("e")).collect()
    assert [r.e.id for r in rows] == [4]  # strictly after
    assert [r.execution.id for r in sync.incremental_payload(example, 300).collect()] == [4]
    assert sync.changed(example, 300, inclusive=True).count() == 2
    _, status, checkpoint = sync.sync_once(lambda: example, example, 10_000, 20_000)
    assert (status, checkpoint) == ("exists", 10_000)


def test_browse_page(example):
    page = browse.browse(example, "P", "P/Prepare", "Dataset", browse.Page(1, 2))
    assert page["total_items"] == 3 and [i["artifact_id"] for i in page["items"]] == [1, 3]
    assert browse.browse(example, "P", "P/Prepare", "Dataset", browse.Page(9, 2)) == {"total_items": 0, "items": []}
    with pytest.raises(ValueError):
        browse.Page(0)


def test_schedules_keep_local_time(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    rows = []
    starts = [datetime(2024, 3, 9, 20), datetime(2024, 11, 2, 20), datetime(2024, 7, 1, 12), datetime(2024, 1, 1, 9)]
    for k, t in enumerate(starts):
        ms = int(t.replace(tzinfo=ZoneInfo("UTC")).timestamp() * 1000)
        rows += [(2 * k, 1, "America/New_York", ms, ms, True, "active", False, 0, "daily", None, None, "09:30", None, None), (2 * k + 1, 1, "Nowhere", ms, ms, True, "active", False, 0, "weekly", None, None, None, "Monday", "09:00")]
    out = {r.id: r.next_run_time_utc for r in control.with_next_run(spark.createDataFrame(rows, CONTROL_TABLES["scheduled_syncs"])).collect()}
    for k, t in enumerate(starts):
        local = datetime.fromtimestamp(out[2 * k] / 1000, ZoneInfo("America/New_York"))
        assert (local.hour, local.minute) == (9, 30) and 0 < out[2 * k] / 1000 - t.replace(tzinfo=ZoneInfo("UTC")).timestamp() <= 25 * 3600
        week = datetime.fromtimestamp(out[2 * k + 1] / 1000, ZoneInfo("UTC"))
        assert (week.weekday(), week.hour) == (0, 9) and week > t.replace(tzinfo=ZoneInfo("UTC"))


def test_strict_tree_drops_what_hangs_on_foreign_parents(example):
    nodes, _ = lineage.artifact_graph(example, "P", strict=True)
    assert nodes.count() == 7  # nothing foreign here
    kept = lineage._without_roots(example.artifact.where("id <> 1").select("id"), lineage.artifact_edges(example).where("parent not in (8, 9)"))
    assert set(ids(kept)) == {8, 9}


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "h1", "x"), ("b", "h2", "y")], "Path string, hash string, key1 string")
    files.write_slice(rows, str(tmp_path / "slice"))
    back = files.update_slice(files.read_slice(spark, str(tmp_path / "slice")), "a", {"key1": "z", "key2": "w"})
    assert sorted((r.Path, r.key1, r.key2) for r in back.collect()) == [("a", "z", "w"), ("b", "y", None)]
    with pytest.raises(KeyError):
        files.update_slice(rows, "c", {})
    steps = selection.numbered_steps(spark.createDataFrame([("s", 2, 0.5), ("s", 1, 0.1)], "series string, t long, loss double"), "series", "t")
    files.write_metrics(steps, str(tmp_path / "metrics"))
    assert files.read_metrics(spark, str(tmp_path / "metrics")).orderBy("SequenceNumber").first().loss == 0.1
    lock = files.lock_stages(spark, {"stages": {"prepare": {"cmd": "python p.py", "deps": [{"path": "d", "md5": "m"}], "outs": [{"path": "o", "md5": "n"}]}}})
    assert [(r.stage, r.direction, r.path) for r in lock.orderBy("direction").collect()] == [("prepare", "deps", "d"), ("prepare", "outs", "o")]


def test_store_on_disk(spark, example, tmp_path):
    example.write_parquet(str(tmp_path / "store"))
    back = MetadataStore.from_parquet(spark, str(tmp_path / "store"))
    assert back.event.count() == 14 and back.stages.count() == 4
    assert export.flat_events(export.payload(back)).count() == 14
    export.write_json(example, str(tmp_path / "json"))
    assert export.row_events(export.read_rows(spark.read.text(str(tmp_path / "json")))).count() == 14


def test_stream_upserts(spark, tmp_path):
    schema = "id long, v string, at long"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (3, "d", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        sync.upsert_stream(spark, source, schema, target, ["id"], "at", str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted((r.id, r.v) for r in sync.read_upserts(spark, target, schema).collect())
    assert got == [(1, "c"), (2, "b"), (3, "d")]
    assert spark.read.parquet(f"{target}/rows/version=000000000002-*").count() == 2  # untouched buckets stay where they are


def test_windows_on_a_stream(spark, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{data}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    q = sync.windowed_events(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from windows").first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_disagreement_and_farthest(spark):
    pool = spark.createDataFrame([(1, [[0.9, 0.1], [0.1, 0.9]]), (2, [[0.5, 0.5], [0.5, 0.5]])], "id long, draws array<array<double>>")
    assert [r.id for r in selection.most_disagreement(pool, 1).collect()] == [1]
    points = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [10.0]), (3, [5.0])], "id long, embedding array<double>")
    assert [r.id for r in selection.farthest_first(points, 2, 0).orderBy("nth").collect()] == [0, 2, 3]


def test_unlinked_producers_without_the_product(spark):
    """jon17: beside all pairs, with any present edges, repeated events and a hot artifact; a hundredfold of pairs isn't made."""
    from provlake.operators import graph

    r = random.Random(7)
    wrote = [(r.randrange(12), r.randrange(40)) for _ in range(120)] + [(99, e) for e in range(300)]
    read = [(r.randrange(12), r.randrange(40)) for _ in range(120)] + [(99, e) for e in range(300)]
    pairs = {(p, c) for a, p in wrote for b, c in read if a == b and p != c}
    present = r.sample(sorted(pairs), 60) + [(s, 5) for s in range(50)] * 2 + [(700, 701)]
    events = [(i, a, e, t, i) for i, (a, e, t) in enumerate([(a, e, 4) for a, e in wrote] + [(a, e, 3) for a, e in read])]
    store = MetadataStore(spark, {"event": spark.createDataFrame(events, "id long, artifact_id long, execution_id long, type int, milliseconds_since_epoch long")})
    want = {}
    for s, d in sorted(pairs - set(present), reverse=True):
        want[d] = s
    got = graph.linked_edges(store, spark.createDataFrame(present, "src long, dst long"))
    assert {x.dst: x.src for x in got.collect()} == want
    plan = graph.linked_edges(store, spark.createDataFrame([(1, 2)], "src long, dst long"))._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" in plan
    assert graph.linked_edges(store, spark.createDataFrame([], "src long, dst long")).count() == len({d for _, d in pairs})
