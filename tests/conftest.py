import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{at}")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(sf_dir + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.fixture(scope="session")
def same(spark, sf_dir, duck):
    """Compare a query with its SQL, row by row."""

    def check(query, sql):
        from collections import Counter

        flat = lambda v: tuple(map(flat, v)) if isinstance(v, list | tuple) else round(v, 9) if isinstance(v, float) else v
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        ours = Counter(flat(tuple(r)) for r in df.select(*names).collect())
        out = duck.execute(sql)
        at = [[d[0] for d in out.description].index(n) for n in names]
        assert len(out.description) == len(names)
        theirs = Counter(flat(tuple(r[i] for i in at)) for r in out.fetchall())
        assert ours == theirs

    return check
