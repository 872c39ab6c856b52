import pytest

from docmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(app="docmill-tests")
