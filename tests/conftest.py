import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from spreadlake.session import local_session

    session = local_session(cores=4, partitions=4, app="spreadlake-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a Column over one-row inputs: evaluate(fn, schema, rows)."""

    def run(fn, schema, rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i int, " + schema)
        out = df.select("_i", fn(df).alias("v")).orderBy("_i").collect()
        return [r["v"] for r in out]

    return run
