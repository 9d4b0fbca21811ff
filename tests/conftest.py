import pytest

from corpusmill.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", 4, "4g")
    yield session
    session.stop()
