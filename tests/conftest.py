import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from filelens.session import get_session, checkpoint_dir

    s = get_session("local[4]", 4)
    checkpoint_dir(s)
    yield s
