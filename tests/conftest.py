import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewire.session import get_session
    return get_session(os.environ.get("TEST_CPUS", "8"), "tests")


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
