import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from twinfold.tables import session

    s = session("4", 4, "4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
