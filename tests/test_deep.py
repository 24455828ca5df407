"""Contraction beside plain walks, on random graphs with long chains and circles."""

import logging
import random

import pytest
from pyspark.sql import functions as F

from provlake import MetadataStore
from provlake.operators import deep, lineage


def graph(seed, chains=4, length=60, extra=40, circles=True):
    """Chains whose nodes also read the node before the last, side edges, a hot node, and circles."""
    r = random.Random(seed)
    edges = set()
    for c in range(chains):
        ids = [1000 * c + k for k in range(length)]
        edges |= set(zip(ids, ids[1:])) | {(ids[k - k % 7], ids[k]) for k in range(1, length) if k % 7}
        edges |= {(ids[-1], 1000 * (c + 1))} if r.random() < 0.6 else set()
    every = sorted({x for e in edges for x in e})
    edges |= {tuple(sorted(r.sample(every, 2))) for _ in range(extra)} | {(every[0], x) for x in r.sample(every, 30)}
    if circles:
        edges |= {(9000, 9001), (9001, 9002), (9002, 9000), (r.choice(every), 9000), (9002, 9100), (9100, 9101), (9102, 9102), (every[-1], every[-3])}
    return sorted(e for e in edges if e[0] != e[1] or e[0] == 9102)


def plain_hops(edges, start):
    out, todo = dict.fromkeys(start, 0), list(start)
    for x in todo:
        for a, b in edges:
            if a == x and b not in out:
                out[b] = out[x] + 1
                todo.append(b)
    return out


def plain_levels(edges, nodes):
    level, parents = {}, {n: {a for a, b in edges if b == n} for n in nodes}
    while ready := [n for n in nodes if n not in level and parents[n] <= level.keys()]:
        level |= {n: max((level[p] + 1 for p in parents[n]), default=0) for n in ready}
    return level


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_and_levels(spark, seed):
    edges = graph(seed)
    frame = spark.createDataFrame(edges, "parent long, child long")
    start = [edges[0][0], 2005]
    got = lineage.closure(frame, spark.createDataFrame([(i,) for i in start], "id long"))
    assert sorted(map(tuple, got.collect())) == sorted(plain_hops(edges, start).items())
    nodes = sorted({x for e in edges for x in e})
    got = lineage.levels(spark.createDataFrame([(n,) for n in nodes], "id long"), frame)
    assert sorted(map(tuple, got.collect())) == sorted(plain_levels(edges, nodes).items())


def test_chains_take_few_rounds(spark, caplog):
    """4,000 hops: the joins follow the logarithm, and nothing is left to walk."""
    n = 4000
    frame = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).alias("w"))
    with caplog.at_level(logging.INFO, "provlake.operators.deep"):
        got = deep.distances(frame, spark.createDataFrame([(0,)], "id long"))
        assert got.where("hops = id").count() == n + 1 == got.count()
        got = deep.longest_paths(frame.select(F.col("src").alias("id")).union(frame.select("dst")), frame)
        assert got.where("level = id").count() == n + 1 == got.count()
    jumps = [m for m in caplog.messages if "jumps" in m]
    assert len(jumps) == 2 and all(int(m.split()[-2]) <= 14 for m in jumps) and [m for m in caplog.messages if "what stayed" in m] == ["0 rounds over what stayed", "1 rounds over what stayed"]


@pytest.mark.parametrize("down", [True, False])
def test_walk_over_a_store(spark, down):
    """Artifacts and executions of a long pipeline with side inputs, circles, stops and a hot artifact, beside a plain walk."""
    r = random.Random(down)
    events = [(a, e, 3) for e in range(120) for a in {e, e - e % 5, r.randrange(0, e + 1)}] + [(e + 1, e, 4) for e in range(120)]
    events += [(0, 90, 4), (50, 110, 4), (400, 500, 3), (401, 500, 4)]
    store = MetadataStore(spark, {"event": spark.createDataFrame([(i, a, e, t, 0) for i, (a, e, t) in enumerate(events)], "id long, artifact_id long, execution_id long, type int, milliseconds_since_epoch long")})
    near, far = (3, 4) if down else (4, 3)
    for stop in (False, True):
        stopped = lambda x: stop and x % 41 == 40  # noqa: B023, E731
        start = [0] if down else [120]
        artifacts, runs, todo = dict.fromkeys(start, 0), {}, list(start)
        for x in todo:
            for e in [] if stopped(x) else [e for a, e, t in events if a == x and t == near and e not in runs]:
                if e in runs:
                    continue
                runs[e] = artifacts[x] + 1
                for a in [] if stopped(e) else [a for a, k, t in events if k == e and t == far and a not in artifacts]:
                    if a not in artifacts:
                        artifacts[a] = runs[e]
                        todo.append(a)
        ends = {"stop_artifacts": F.col("id") % 41 == 40, "stop_executions": F.col("id") % 41 == 40} if stop else {}
        got = lineage.walk(store, spark.createDataFrame([(i,) for i in start], "id long"), down, **ends)
        assert [dict(map(tuple, x.collect())) for x in got] == [artifacts, runs] and [x.count() for x in got] == [len(artifacts), len(runs)]


@pytest.mark.parametrize("down", [True, False])
def test_a_growing_walk_is_not_contracted(spark, monkeypatch, down):
    """Seven hops that double what is reached: contraction would take the whole store along for a walk that is nearly over."""
    monkeypatch.setattr(deep, "distances", lambda *_: pytest.fail("contracted"))
    n = 2**7 - 1
    near, far = (3, 4) if down else (4, 3)
    events = [(i, i, near) for i in range(n)] + [(2 * i + k, i, far) for i in range(n) for k in (1, 2)]
    frame = spark.createDataFrame([(i, a, e, t, 0) for i, (a, e, t) in enumerate(events)], "id long, artifact_id long, execution_id long, type int, milliseconds_since_epoch long")
    start = spark.createDataFrame([(0,)], "id long")
    want = {i: (i + 1).bit_length() - 1 for i in range(2 * n + 1)}
    artifacts, runs = lineage.walk(MetadataStore(spark, {"event": frame}), start, down)
    assert dict(map(tuple, artifacts.collect())) == want and dict(map(tuple, runs.collect())) == {i: want[i] + 1 for i in range(n)}
    edges = spark.createDataFrame([(i, 2 * i + k) for i in range(n) for k in (1, 2)], "parent long, child long")
    assert dict(map(tuple, lineage.closure(edges, start).collect())) == want
