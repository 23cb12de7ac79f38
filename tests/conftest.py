from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from trailmark.session import local_session, prepare

    session = local_session(cores=os.environ.get("TEST_CPUS", "8"), partitions=4, name="trailmark-tests")
    session.sparkContext.setLogLevel("ERROR")
    prepare(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
