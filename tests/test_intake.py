"""Payload text with bad items: what goes on, what is set aside, and a merge of the good part."""

import json

from pyspark.sql import functions as F
from test_lineage import make

from provlake.operators import export, intake, merge


def line(run=7, **changes):
    art = {"id": 5, "name": "a", "type": "Dataset", "uri": "u"}
    one = {"pipeline": {"id": 1, "name": "P"}, "stage": {"id": 2, "name": "P/S"}, "execution": {"id": run, "name": "", "type": "Run", "events": [{"type": 3, "artifact": art}]}}
    return one | changes


def run(events, **changes):
    return {"id": 7, "name": "n", "type": "Run", "events": events} | changes


def art(**changes):
    return {"id": 5, "name": "a", "type": "Model", "uri": "u"} | changes


CASES = [
    (None, [("line", "corrupt_json", None)]), ("", [("line", "corrupt_json", None)]), ("{\"pipeline\": {", [("line", "corrupt_json", None)]), ("[1]", [("line", "corrupt_json", None)]),
    (json.dumps([line()]), [("line", "corrupt_json", None)]), ("7", [("line", "corrupt_json", None)]), ("{}", [("line", "no_pipeline", None)]),
    (line(pipeline=None), [("line", "no_pipeline", None)]), (line(pipeline={"id": 1, "name": " "}), [("line", "no_pipeline", None)]), (line(pipeline={"id": "x", "name": "P"}), [("line", "no_pipeline", None)]), (line(pipeline=3), [("line", "no_pipeline", None)]),
    (line(stage=None), [("line", "no_stage", None)]), (line(stage={"name": "P/S"}), [("line", "no_stage", None)]),
    (line(execution="text"), [("execution", "corrupt_execution", None)]), (line(execution={"id": "seven"}), [("execution", "corrupt_execution", None)]), (line(execution={"id": 1, "events": 5}), [("execution", "corrupt_execution", None)]), (line(execution={"name": "no id"}), [("execution", "execution_without_id", None)]),
    (line(execution=run(["text", None, {"type": "out"}])), [("event", "corrupt_event", 1), ("event", "corrupt_event", 2), ("event", "corrupt_event", 3)]),
    (line(execution=run([{"type": 3, "artifact": art()}, {"type": 5, "artifact": art()}, {"artifact": art()}, {"type": 4}, {"type": 4, "artifact": None}])), [("event", "unknown_direction", 2), ("event", "unknown_direction", 3), ("event", "event_without_artifact", 4), ("event", "event_without_artifact", 5)]),
    (line(execution=run([{"type": 3, "artifact": art(type="Odd")}, {"type": 3, "artifact": art(type=None)}, {"type": 3, "artifact": art(name="", uri=None)}, {"type": 3, "artifact": art(id=6, uri="")}])), [("event", "unknown_type", 1), ("event", "unknown_type", 2), ("event", "artifact_without_key", 3)]),
    (line(), []), (line(execution=None), []), (line(execution=None, stage=None), []), (line(execution=run(None)), []), (line(execution=run([]), more={"x": [1]}), []),
]


def test_each_item_is_in_one_of_both(spark):
    texts = [(i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, (t, _) in enumerate(CASES)]
    rows, rejects = intake.read_checked(spark.createDataFrame(texts, "n int, value string"), place="n")
    assert tuple(rejects.columns) == intake.REJECTS
    got = rejects.collect()
    for i, (t, want) in enumerate(CASES):
        assert sorted((r.item, r.reason, r.nth) for r in got if r.place == str(i)) == sorted(want, key=lambda w: (w[0], w[1], w[2] or 0)), t
    lines = len(CASES) - sum(w[0][0] == "line" for _, w in CASES if w)
    runs = [r.execution for r in rows.collect()]
    assert len(runs) == lines
    sent = sum(len((t["execution"].get("events")) or []) for t, w in CASES if isinstance(t, dict) and isinstance(t.get("execution"), dict) and not (w and w[0][0] != "event"))
    assert sum(len(r.events or []) for r in runs if r) + sum(r.item == "event" for r in got) == sent
    assert {r.raw for r in got if r.reason == "corrupt_execution"} == {"text", '{"id":"seven"}', '{"id":1,"events":5}'}


def test_no_text(spark):
    rows, rejects = intake.read_checked(spark.createDataFrame([], "value string"))
    assert rows.count() == 0 == rejects.count() and intake.to_store(rows).execution.count() == 0


def test_good_part_is_merged(spark):
    events = [(1, 1, 3), (2, 1, 4), (2, 2, 3), (3, 2, 4)]
    store = make(spark, [(1, "P/A", "aaaa-1"), (2, "P/B", "bbbb-1,bbbb-2")], [(1, "Dataset", "a:1"), (2, "Model", "m:2:1"), (3, "Label", "l:3")], events)
    text = export.rows_json(export.payload_rows(store))
    new = make(spark, [(8, "P/A", "old")], [(1, "Dataset", "z:9")], [(1, 8, 4)])
    counts = lambda s: [getattr(s, t).count() for t in ("context", "execution", "artifact", "event", "association", "attribution", "parentcontext", "executionproperty")]
    whole, none = intake.merge_text(new, text)
    assert none.count() == 0 and counts(whole) == counts(merge.merge_stores(new, store, kinds=merge.MERGED_TYPES))
    again, _ = intake.merge_text(whole, text)
    assert counts(again) == counts(whole)
    bad = text.withColumn("value", F.regexp_replace("value", '"type":"Label"', '"type":"Lebal"')).union(spark.createDataFrame([("{",)], "value string"))
    part, rejects = intake.merge_text(new, bad)
    assert sorted((r.reason, r.execution_id) for r in rejects.collect()) == [("corrupt_json", None), ("unknown_type", 2)]
    assert part.event.count() == whole.event.count() - 1 and part.artifact.count() == whole.artifact.count() - 1
    assert part.execution.count() == whole.execution.count()


def test_payload_rows_neither_broadcast_nor_by_stage(spark, data):
    """Property maps outgrow their files, and nested rows of one stage would all meet in one task."""
    from provlake.plans import adapter

    lines = export.payload_rows(adapter.load(spark, data, "a"), "ASIA")._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x or "hashpartitioning(context_id" in x:
            below = next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(x)), len(lines))
            assert not any("collect_" in y for y in lines[i:below]), x
