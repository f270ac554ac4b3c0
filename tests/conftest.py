from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lossgrid.session import local_session  # noqa: E402
from lossgrid.sources.readers import Portfolio  # noqa: E402
from lossgrid.sources.schemas import SCHEMAS  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, shuffle_partitions=4)
    yield s
    s.stop()


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def m(x) -> Decimal | None:
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


@pytest.fixture
def portfolio(spark):
    """Build a Portfolio from literal rows (tables not given are empty)."""

    def build(**tables) -> Portfolio:
        frames = {}
        for name, schema in SCHEMAS.items():
            rows = []
            for r in tables.get(name, []):
                r = list(r)
                for i, f in enumerate(schema.fields):
                    if f.dataType.typeName() == "decimal" and r[i] is not None:
                        r[i] = m(r[i])
                    if f.dataType.typeName() == "date" and isinstance(r[i], str):
                        r[i] = d(r[i])
                rows.append(tuple(r))
            frames[name] = spark.createDataFrame(rows, schema)
        return Portfolio(**frames)

    return build
