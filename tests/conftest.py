import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session
    return local_session("4", 4, "tests")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
