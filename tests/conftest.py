import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from flowaudit.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores="4", partitions="4", memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()
