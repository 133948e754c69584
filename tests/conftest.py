import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)


@pytest.fixture(scope="session")
def spark():
    from foliant.session import local_session

    s = local_session(cores="4", memory="4g", shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
