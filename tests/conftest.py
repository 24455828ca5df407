import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp()}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def data():
    return DATA


def _plain(v):
    if v is None or type(v).__name__ in ("NaTType", "NAType"):
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="session")
def same_rows(spark, duck, data):
    """Compare a query's rows with its SQL's, without order."""

    def compare(query, sql):
        df = query(spark, data)
        names = sorted(df.columns)
        mine = sorted(([_plain(r[c]) for c in names] for r in df.collect()), key=repr)
        rel = duck.execute(sql)
        columns = [d[0] for d in rel.description]
        assert sorted(columns) == names
        theirs = sorted(([_plain(dict(zip(columns, r, strict=True))[c]) for c in names] for r in rel.fetchall()), key=repr)
        assert len(mine) == len(theirs)
        assert repr(mine) == repr(theirs)

    return compare
