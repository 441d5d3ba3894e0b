import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether two pandas frames hold the same rows, in any order, numbers to a relative 1e-9."""
    import numpy as np

    def check(a, b):
        cols = sorted(a.columns)
        assert cols == sorted(b.columns) and len(a) == len(b)
        keys = [c for c in cols if a[c].dtype != float] + [c for c in cols if a[c].dtype == float]
        x, y = (f.sort_values(keys).reset_index(drop=True) for f in (a, b))
        for c in cols:
            if x[c].dtype == float:
                assert np.allclose(x[c], y[c].astype(float), rtol=1e-9, atol=2e-6, equal_nan=True), c
            else:
                assert (x[c].astype(str) == y[c].astype(str)).all(), c

    return check
