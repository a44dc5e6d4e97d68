import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ferrule.session import get_session

    s = get_session("local[4]", app_name="ferrule-tests", shuffle_partitions=4)
    yield s


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)
