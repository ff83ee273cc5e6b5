from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pitwall import schema  # noqa: E402
from pitwall.session import spark_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = spark_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("staging")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_results(spark):
    """Results from short tuples: (driver, date, round, mode, position, grid, points, status)."""

    def make(rows, year_of=None):
        full = []
        for driver, date, number, mode, position, grid, points, status in rows:
            day = dt.date.fromisoformat(date) if isinstance(date, str) else date
            year = (year_of or (lambda d: d.year))(day) if day else None
            stamp = dt.datetime(day.year, day.month, day.day, 14, tzinfo=dt.timezone.utc) if day else None
            full.append(
                (driver, year, number, stamp, mode, position, grid, points, status, "t", "Team", "AABBCC", driver)
            )
        return spark.createDataFrame(full, schema.RESULTS)

    return make


def to_pandas(df) -> pd.DataFrame:
    return df.toPandas()
