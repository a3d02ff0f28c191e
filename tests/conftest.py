import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from peakloom.session import ship

    return ship(session)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def same_rows(a, b):
    """Frames with the same columns and, in any order, the same rows."""
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    a, b = (x[columns].astype(object).where(x[columns].notna(), None).values.tolist() for x in (a, b))
    key = lambda r: [(v is None, str(v)) for v in r]
    norm = lambda rows: sorted(([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r] for r in rows), key=key)
    assert norm(a) == norm(b)
