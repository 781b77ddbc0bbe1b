import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallymill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of a column expression over string inputs (column s)."""

    def run(make, values, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}").coalesce(1)
        return [r[0] for r in df.select(make(F.col("s")).alias("x"), "i").orderBy("i").select("x").collect()]

    return run
