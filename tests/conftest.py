import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ragloom.session import local_session

    os.environ.setdefault("RAGLOOM_PARTITIONS", "4")
    os.environ.setdefault("RAGLOOM_DRIVER_MEMORY", "4g")
    s = local_session("ragloom-tests", os.environ.get("TEST_CPUS", "4"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
