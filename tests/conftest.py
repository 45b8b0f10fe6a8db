import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("LECTERN_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lectern.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
