from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from quadlake.session import local_session

    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
