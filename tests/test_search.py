"""The search index beside ilike over everything, through updates."""

import random

import pytest
from pyspark.sql import functions as F

from provlake import MetadataStore
from provlake.checkpoint import scratch_path
from provlake.operators import browse, search
from provlake.operators.buckets import Conflict

SCHEMA = "id long, text string"
WORDS = ["Straße", "ÄRGER", "100%", "a_b", "train", "TRAINING", "data", "x", "\n", "日本語", ""]


def texts(r, n):
    return [" ".join(r.choice(WORDS) for _ in range(r.randrange(6))) for _ in range(n)]


def test_candidates_hold_every_match(spark):
    r = random.Random(4)
    now = {i: t for i, t in enumerate(texts(r, 150))}
    index = search.Index(spark, scratch_path(spark, "index"))
    assert index.candidates("train").count() == 0 and index.candidates("a%") is None
    for step in range(3):
        if step:
            changed = {i: t for i, t in zip(r.sample(range(170), 40), texts(r, 40))} | {3: None}
            now |= changed
        else:
            changed = now
        index.update(spark.createDataFrame([*changed.items(), (None, "lost")], SCHEMA))
        frame = spark.createDataFrame(list(now.items()), SCHEMA)
        for pattern in ("train", "RAINing", "straße", "ärg%ain", "100%", "日本語", "nothing like it", "ata x"):
            match = {x.id for x in frame.where(F.col("text").ilike(f"%{pattern}%")).collect()}
            found = {x.id for x in index.candidates(pattern).collect()}
            assert match <= found and found <= {i for i, t in now.items() if t}, pattern
            if pattern in ("train", "日本語"):
                assert found == match


def test_an_update_touches_its_buckets_only(spark, monkeypatch):
    index = search.Index(spark, scratch_path(spark, "index"))
    index.update(spark.createDataFrame([(i, f"text number {i * 7919}") for i in range(300)], SCHEMA))
    before = index.manifest()
    index.update(spark.createDataFrame([(5, f"text number {5 * 7919} and zzq")], SCHEMA))
    after = index.manifest()
    moved = [b for b in after["postings"] if after["postings"][b] != before["postings"].get(b)]
    assert 0 < len(moved) < 12 and sum(after["entities"][b] != before["entities"].get(b) for b in after["entities"]) == 1
    assert index.vacuum() == 1 + sum(b in before["postings"] for b in moved) and index.vacuum() == 0
    assert {x.id for x in index.candidates("ZZQ").collect()} == {5} and after["version"] == before["version"] + 1


def test_a_slower_writer_fails_and_loses_nothing(spark):
    path = scratch_path(spark, "index")
    index, other = search.Index(spark, path), search.Index(spark, path)
    index.update(spark.createDataFrame([(1, "alpha")], SCHEMA))
    old = other.manifest()
    index.update(spark.createDataFrame([(2, "alphabet")], SCHEMA))
    other.manifest = lambda: old
    with pytest.raises(Conflict):
        other.update(spark.createDataFrame([(3, "alphas")], SCHEMA))
    assert {x.id for x in index.candidates("alpha").collect()} == {1, 2}


def test_pages_with_an_index(spark, data):
    """The same page with candidates as without; candidates are a small share."""
    from provlake.plans import adapter

    store = adapter.load(spark, data, "a")
    assert isinstance(store, MetadataStore)
    index = search.Index(spark, scratch_path(spark, "index"))
    index.update(search.execution_texts(store))
    for text in ("1-urgent", "bool", "no such text", "%4-not%"):
        page = browse.Page(1, 20, descending=True, search=text)
        plain = browse.executions_page(store, "ASIA", "ASIA/NATION_17", page).collect()
        assert browse.executions_page(store, "ASIA", "ASIA/NATION_17", page, index.candidates(text)).collect() == plain
    assert index.candidates("1-urgent").count() < store.execution.count() / 3


def test_a_gram_that_many_have_is_a_row_for_each_block(spark):
    """Rows follow blocks and grams, not every gram of every text; ids far apart, negative or next to a block's ends are found."""
    ids = [*range(-5, 3 * search.BLOCK), 2**62, -(2**61)]
    index = search.Index(spark, scratch_path(spark, "index"))
    index.update(spark.createDataFrame([(i, f"run of {'odd' if i % 2 else 'even'} number {i % 100}") for i in ids], SCHEMA))
    rows = index.read(index.manifest(), "postings", list(range(search.BUCKETS)))
    assert rows.count() < len(ids) and rows.where("gram = 'run'").agg(F.sum("n")).first()[0] == len(ids)
    assert {r.id for r in index.candidates("%odd%").collect()} == {i for i in ids if i % 2}
    assert {r.id for r in index.found("EVEN number 7%").collect()} == {i for i in ids if i % 2 == 0 and str(i % 100).startswith("7")}
    assert index.found("4_").count() == sum(str(i % 100)[:1] == "4" and i % 100 > 9 for i in ids)
    index.update(spark.createDataFrame([(search.BLOCK, None), (2**62, "run of nothing")], SCHEMA))
    assert {r.id for r in index.candidates("even").collect()} == {i for i in ids if i % 2 == 0} - {search.BLOCK, 2**62}
    assert {r.id for r in index.found("nothing", spark.createDataFrame([(1,), (2**62,)], "id long")).collect()} == {2**62}


def test_the_query_keeps_its_index_up(spark, data, monkeypatch):
    """flt28_search_by_index: the index is made from a pipeline's executions and then kept up with the others, each put in once, as if made at once."""
    from provlake.plans import QUERIES, adapter

    put, update = [], search.Index.update

    def watched(index, texts):
        update(index, texts)
        put.append((index, {r.id: r.text for r in texts.collect()}))

    monkeypatch.setattr(search.Index, "update", watched)
    found = {r.execution_id for r in QUERIES["flt28_search_by_index"](spark, data).collect()}
    store = adapter.load(spark, data)
    (index, first), (same, then) = put
    mine = {r.id for r in browse.pipeline_executions(store, "ASIA").collect()}
    assert same is index and index.manifest()["version"] == 2 and first.keys() == mine and not mine & then.keys()
    assert first | then == {r.id: r.text for r in search.execution_texts(store).collect()}
    assert found and found <= mine
    whole = search.Index(spark, scratch_path(spark, "index"))
    update(whole, search.execution_texts(store))
    for kind in ("entities", "postings"):
        rows = [sorted(map(tuple, i.read(i.manifest(), kind, list(range(search.BUCKETS))).collect())) for i in (index, whole)]
        assert rows[0] == rows[1] and rows[0], kind
