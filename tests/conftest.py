from __future__ import annotations

import pytest

from slotwise.session import local_session
from slotwise.sources.store import Tables


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def tables(spark):
    """Build tables from {name: (rows, schema)} or ready frames."""

    def build(**frames):
        ready = {
            name: spark.createDataFrame(*frame) if isinstance(frame, tuple) else frame for name, frame in frames.items()
        }
        return Tables({name: (lambda _t, f=f: f) for name, f in ready.items()})

    return build


def rows(df):
    """Rows as sorted plain tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [str(v) for v in r])
