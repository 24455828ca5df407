"""Every registered query of the metadata operators beside its SQL."""

import pytest

from provlake import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(name, same_rows):
    same_rows(plans.QUERIES[name], plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_sql_runs(name, spark, data):
    rows = plans.QUERIES[name](spark, data)
    assert rows.columns and rows.count() > 0


def test_links_of_an_execution_with_the_number_of_the_sql(spark, duck, tmp_path):
    """wrt06: on larger tables there is an execution 999999."""
    from provlake.plans import ORACLE, QUERIES

    for t in ("region", "nation", "customer", "part", "events", "orders", "lineitem"):
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(t)
        duck.execute(f"COPY (SELECT * {f'REPLACE ({key} + 999000 AS {key})' if key else ''} FROM {t}) TO '{tmp_path}/{t}.parquet'")
    other = duck.cursor()
    other.execute("CREATE SCHEMA large")
    other.execute("SET schema = 'large'")
    for t in ("region", "nation", "customer", "part", "events", "orders", "lineitem"):
        other.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = sorted(other.execute(ORACLE["wrt06_link_absent"]).fetchall())
    got = sorted((r.artifact_id, r.execution_id, r.type) for r in QUERIES["wrt06_link_absent"](spark, str(tmp_path)).collect())
    assert got == want and sum(r[1] == 999999 for r in want) > duck.execute("SELECT count(*) FROM part").fetchone()[0]


def test_best_trials_without_metrics(spark, duck):
    """agg10: steps without metric and trials of nothing else, as arg_max has them; equal steps are left open by it, and the first one's here."""
    from provlake.operators import selection

    rows = [(1, 1, None, "a"), (1, 2, 3.0, "b"), (1, 3, 3.0, "c"), (2, 1, None, "d"), (3, 1, float("nan"), "e"), (3, 2, 1.0, "f")]
    steps = spark.createDataFrame(rows, "trial int, step int, metric double, model string")
    best = lambda largest: {r.trial: r.model for r in selection.best_trials(steps, "metric", largest=largest).collect()}
    assert best(True) == {1: "b", 2: None, 3: "e"} and best(False) == {1: "b", 2: None, 3: "f"}
    values = ", ".join(f"({t}, {'NULL' if m is None else repr(str(m))}::DOUBLE, '{x}')" for t, s, m, x in rows if x != "c")
    assert dict(duck.execute(f"SELECT t, arg_max(x, m) FROM (VALUES {values}) AS v(t, m, x) GROUP BY t").fetchall()) == best(True)


def test_best_trials_without_models(spark, duck, tmp_path):
    """agg10: arg_max passes over steps without model, max doesn't."""
    rows = "(1, NULL, 9.0), (1, 11, 3.0), (1, 12, 4.0), (2, NULL, 1.0), (3, 31, NULL), (3, NULL, 2.0)"
    duck.execute(f"COPY (SELECT u::BIGINT AS user_id, e::BIGINT AS event_id, v::DOUBLE AS value FROM (VALUES {rows}) AS t(u, e, v)) TO '{tmp_path}/events.parquet'")
    other = duck.cursor()
    other.execute("CREATE SCHEMA nameless")
    other.execute("SET schema = 'nameless'")
    other.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(other.execute(plans.ORACLE["agg10_best_trials"]).fetchall())
    assert want == [(1, "model-12", 9.0), (2, None, 1.0), (3, None, 2.0)]
    assert sorted(tuple(r) for r in plans.QUERIES["agg10_best_trials"](spark, str(tmp_path)).select("trial", "model", "best").collect()) == want
