import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL on the smallest tables."""

    def check(query, sql):
        ours = query(spark, SMALL)
        got = [tuple(r[c] for c in sorted(ours.columns)) for r in ours.collect()]
        frame = duck.sql(sql).arrow()
        table = frame.read_all() if hasattr(frame, "read_all") else frame
        assert sorted(table.column_names) == sorted(ours.columns)
        want = list(zip(*(table.column(c).to_pylist() for c in sorted(ours.columns)))) if table.num_rows else []
        key = lambda r: repr([float(x) if isinstance(x, (int, float)) else x for x in r])
        assert sorted(map(key, got)) == sorted(map(key, want))

    return check
