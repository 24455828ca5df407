"""Deep pages beside a plain sort."""

import random

import pytest

from provlake.operators import paging


@pytest.mark.parametrize("kind", ["double", "string"])
def test_pages_as_a_sort_has_them(spark, kind, monkeypatch):
    """Ties, nulls, a key with a third of all rows, pages across ranges, at the end and past it."""
    monkeypatch.setattr(paging, "SPLITS", 4)
    monkeypatch.setattr(paging, "SAMPLE", 40)
    r = random.Random(kind)
    make = {"double": lambda: float(r.randrange(-50, 50)), "string": lambda: r.choice(["a", "B", "é", "\U0001f600", "\uff5e", ""]) * r.randrange(3) + str(r.randrange(20))}[kind]
    rows = [(r.choice([make(), make(), make(), None, make() if i % 3 else ({"double": 7.0, "string": "hot"}[kind])]), i) for i in range(900)]
    frame = spark.createDataFrame(rows, f"k {kind}, id long").repartition(3)
    place = lambda k: k.encode() if isinstance(k, str) else k
    for descending, nulls_last, offset, size in ((False, True, 300, 7), (True, True, 620, 60), (True, False, 150, 200), (False, False, 880, 50), (False, True, 5000, 5)):
        some = sorted((x for x in rows if x[0] is not None), key=lambda x: x[1])
        some.sort(key=lambda x: place(x[0]), reverse=descending)
        none = sorted(x for x in rows if x[0] is None)
        want = (some + none if nulls_last else none + some)[offset : offset + size]
        got = paging.seek(frame, "k", "id", offset, size, descending, nulls_last, direct=20)
        assert [(x.k, x.id) for x in got.collect()] == want


def test_first_pages_are_top_lists(spark):
    frame = spark.range(100).selectExpr("id % 7 as k", "id")
    page = paging.seek(frame, "k", "id", 10, 5)
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString() and [x.id for x in page.collect()] == [70, 77, 84, 91, 98]
    assert paging.seek(frame.limit(0), "k", "id", 20_000, 5).collect() == []
