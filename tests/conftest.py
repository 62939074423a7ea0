import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomspark.session import local_session
    from loomspark.streaming.stateful import STATE_STORE

    session = local_session("tests", os.environ.get("TEST_CPUS", "4"), 4)
    session.conf.set(*STATE_STORE)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
