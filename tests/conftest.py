import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TICKLOOM_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import session

    s = session("tests", cpus=4, shuffle=4)
    yield s
    s.stop()
