import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.01"


def table_rows(df):
    """Rows as comparable tuples, columns by name, floats rounded, in any order."""

    def value(x):
        if isinstance(x, float):
            return "nan" if x != x else round(x, 6)
        if isinstance(x, (bytes, bytearray)):
            return bytes(x).hex()
        if isinstance(x, (list, tuple)):
            return tuple(map(value, x))
        return x

    names, rows = df
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a query with its SQL in DuckDB on a folder's tables."""
    import glob

    import duckdb

    def check(spark, folder, query, sql):
        con = duckdb.connect()
        for p in glob.glob(f"{folder}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        df, rel = query(spark, folder), con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        got, want = table_rows((df.columns, [tuple(r) for r in df.collect()])), table_rows((rel.columns, rel.fetchall()))
        assert len(got) == len(want)
        assert got == want

    return check
