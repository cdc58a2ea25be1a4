"""One local session for all tests; comparison of a query with its SQL."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = Path(DATA, f"{name}.parquet")
        con.sql(f"create view {name} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    clean = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else (float(v) if isinstance(v, float) else v)
    return sorted((tuple(str(clean(v)) for v in r) for r in df.itertuples(index=False)))


@pytest.fixture(scope="session")
def same():
    """Whether a Spark result has the columns and rows of a SQL result."""

    def check(got: pd.DataFrame, want: pd.DataFrame) -> None:
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)

    return check
