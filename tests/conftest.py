import os
import sys

import pytest

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import session

    s = session("local[4]", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
