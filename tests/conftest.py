import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted((tuple(plain(x) for x in r) for r in frame.select(*names).collect()), key=repr)


@pytest.fixture(scope="session")
def oracle():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")

    def ask(sql):
        found = db.sql(sql)
        order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
        return sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)

    return ask
