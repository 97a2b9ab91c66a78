import pytest

from attestra.session import clear_scratch, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()
