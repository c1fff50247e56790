import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from arbora.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_segments(monkeypatch):
    """Cut scans into tiny segments, as a very long document would be."""
    from arbora.operators import scan

    monkeypatch.setattr(scan, "PAGES_PER_SEGMENT", 1)
    monkeypatch.setattr(scan, "ROWS_PER_SEGMENT", 2)
