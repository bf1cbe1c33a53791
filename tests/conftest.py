import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracewell.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, partitions=8, memory="4g")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
