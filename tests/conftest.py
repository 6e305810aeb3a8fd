import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from feedloom.operators.staging import release  # noqa: E402
from workloads.check import connect, local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SF_DIR)
