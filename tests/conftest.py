import sys

import pytest

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")


@pytest.fixture(scope="session")
def spark():
    from skytable.session import local_session

    session = local_session("tests", 8, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
