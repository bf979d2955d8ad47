import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from phasegrid.session import local_session

    session = local_session(8, "phasegrid-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("driver tables are not here")
    return DATA
