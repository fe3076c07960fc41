import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def same(spark, sf):
    """same(function, sql): the query's rows over the test tables equal DuckDB's."""
    import duckdb

    def check(function, sql):
        db = duckdb.connect()
        for file in os.listdir(sf):
            db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{file}')")
        mine, theirs = function(spark, sf).toPandas(), db.execute(sql).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        columns = sorted(mine.columns)
        plain = lambda df: sorted(str([_plain(v) for v in row]) for row in df[columns].itertuples(index=False))
        assert plain(mine) == plain(theirs)

    return check


def _plain(value):
    import pandas as pd

    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if value is None or value is pd.NaT or value is pd.NA or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6) + 0.0 if value % 1 else int(value)
    return value
