import pytest

from tabloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(partitions=4)
