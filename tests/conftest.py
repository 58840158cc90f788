import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from attestra.session import build_session
    return build_session("tests", master="local[8]", cores=8)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column expression over literal string columns."""
    def run(build, **texts):
        from pyspark.sql import functions as F
        row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in texts.items()] or [F.lit(1).alias("x")])
        return row.select(build(*[F.col(k) for k in texts]).alias("v")).first()["v"]
    return run
