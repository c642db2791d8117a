import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from roomledger.session import get_session
    s = get_session("local[*]", 8, app_name="roomledger-tests")
    yield s
    s.stop()


def rows(df, order=None):
    """Collect as a sorted list of plain tuples."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda t: tuple("" if v is None else str(v) for v in t)) if order is None else out
