import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veiltext.session import local_session  # noqa: E402


# Started at import, because columns at module level need a session.
SESSION = local_session(8, "tests")
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
