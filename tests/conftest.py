import pytest

from strandloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores=8, partitions=4, memory="6g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
