import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401  (registers the package for the executors)
    from loomframe.core.session import build_session, delete_scratch

    session = build_session(8)
    yield session
    delete_scratch(session)
    session.stop()


SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
