import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kbweave.config import checkpoint_root, get_session
    s = get_session("local[4]", app="kbweave-tests", shuffle_partitions=4)
    checkpoint_root(s)  # tests set their own folder only when the session has none
    yield s
