import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_TINY = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from flawscope.session import build_session

    s = build_session("*", 8)
    yield s
    from flawscope.session import drop_scratch

    drop_scratch(s)
    s.stop()


@pytest.fixture
def tmp_out(spark):
    from flawscope.session import scratch_dir

    return scratch_dir(spark, "test")
