import pytest

from tidelake.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "4")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
