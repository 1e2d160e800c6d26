import os
import sys
import tempfile

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fixtrace.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
DATA = os.environ.get("FIXTRACE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[*]", "fixtrace-tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="fixtrace-tests-"), "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


@pytest.fixture
def one(spark):
    """Value of a column expression over one row."""
    from pyspark.sql import functions as F

    def value(function, *values, **options):
        # repr keeps the values out of the constant folder's way: they come from a table.
        row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        result = row.select(function(*[F.col(f"c{i}") for i in range(len(values))], **options).alias("v")).first()[0]
        return result.asDict(recursive=True) if hasattr(result, "asDict") else result

    return value
