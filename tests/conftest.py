import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanwise.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session("local[*]", 4)


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


EPISODE_SCHEMA = "region string, started_at timestamp_ntz, finished_at timestamp_ntz"
