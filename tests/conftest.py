import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parcelwise.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="parcelwise-test-")
