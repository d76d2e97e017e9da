"""One Spark session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lumora.session import session

    s = session(8, 4, "8g")
    s.sparkContext.setLogLevel("ERROR")
    return s
