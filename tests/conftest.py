from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    session = local_session(4, 4, "3g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    folder = f"{DATA}/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test data not present")
    return folder
