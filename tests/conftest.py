import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rebaja.session import builder  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = builder("tests", "8", 8).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def run(spark):
    from rebaja.plans.queries import run_of
    return run_of(spark, SF)


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a Column on one row of literals."""
    from pyspark.sql import functions as F

    def evaluate(column, **row):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()] or ["id"])
        return df.select(column.alias("v")).first()["v"]
    return evaluate
