import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from rolecall.session import get_spark

    session = get_spark(
        "tests",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column expression over one row."""

    def evaluate(column, **row):
        from pyspark.sql import functions as F

        frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()] or ["id"])
        return frame.select(column.alias("v")).first().v

    return evaluate
