import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(__file__), "..")
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(__file__))
os.environ["PYTHONPATH"] = os.path.abspath(ROOT) + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from packetloom.session import local_session

    session = local_session("4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
