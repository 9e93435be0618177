import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ohmwatch.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def series(spark):
    """Build an hourly frame of one or more assets from plain lists."""

    def build(columns: dict, asset: int = 0, start: dt.datetime = START):
        n = len(next(iter(columns.values())))
        kinds = {str: "string", int: "int"}
        shape = ", ".join(
            f"{c} {kinds.get(type(next((v for v in vs if v is not None), 0.0)), 'double')}"
            for c, vs in columns.items()
        )
        rows = [
            (asset, start + dt.timedelta(hours=i), *[vs[i] for vs in columns.values()])
            for i in range(n)
        ]
        return spark.createDataFrame(rows, f"asset_id int, ts timestamp_ntz, {shape}")

    return build


@pytest.fixture(scope="session")
def column():
    def values(df, name, order=("asset_id", "ts")):
        return [r[0] for r in df.orderBy(*order).select(name).collect()]

    return values
