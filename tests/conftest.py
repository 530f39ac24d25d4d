import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vigil.session import get_session
    ck = tempfile.mkdtemp(prefix="vigil-test-ck-")
    s = get_session("local[8]", shuffle_partitions=8, app="vigil-tests",
                    extra={"spark.checkpoint.dir": ck})
    yield s
    s.stop()


SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"
