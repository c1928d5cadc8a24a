import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sheafwork.session import ship

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Compares a query with its SQL: the same columns and the same rows."""

    def compare(query, sql):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
        result = duck.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == names
        want = sorted((tuple(r[columns.index(c)] for c in names) for r in result.fetchall()), key=repr)
        assert got == want

    return compare
