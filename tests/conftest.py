from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradeweave.session import local_session  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="tradeweave-tests")
    yield s


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)


def rows(df, order=None):
    """Collect as sorted list of dicts (small frames only)."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    if order:
        out.sort(key=lambda d: tuple((d[k] is None, d[k]) for k in order))
    return out
