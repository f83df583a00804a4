import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from missive.session import get_session
    s = get_session("local[4]", 4, app_name="missive-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="missive-test-ckpt-"))
    yield s
    s.stop()


SF001 = "/root/testdata/sf0.001"
