import os

import pytest

from tidewire.session import local_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("4", partitions=4, name="tidewire-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
