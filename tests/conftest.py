import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from subjex.session import ensure_checkpoint_dir, get_session
    s = get_session("local[4]", 8)
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


SMOKE = "/root/testdata/sf0.001"
