import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from geostrata.runtime import session

    s = session("tests", cpus="4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
