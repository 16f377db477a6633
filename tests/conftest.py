import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankspark.session import build_session, drop_cuts  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_cuts(session)


@pytest.fixture
def small_groups(spark):
    """Make every group of more than 20 rows count as large, with chunks of 16 rows."""
    spark.conf.set("spark.rankspark.groupRows", "20")
    spark.conf.set("spark.rankspark.chunkRows", "16")
    yield
    spark.conf.unset("spark.rankspark.groupRows")
    spark.conf.unset("spark.rankspark.chunkRows")


def rows(df, *cols):
    """Sorted rows with floats rounded, for order-free comparison."""

    def norm(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        if isinstance(v, list):
            return tuple(norm(x) for x in v)
        return v

    picked = df.select(*cols) if cols else df
    return sorted((tuple(norm(v) for v in r) for r in picked.collect()), key=repr)
