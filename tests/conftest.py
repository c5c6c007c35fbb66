import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postlake.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def one(spark):
    """Evaluate expressions over named literals: one(expr, **values)."""
    from pyspark.sql import functions as F

    def run(build, **values):
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} STRING" for k in values))
        return df.select(build(*[F.col(k) for k in values]).alias("x")).collect()[0]["x"]

    return run
