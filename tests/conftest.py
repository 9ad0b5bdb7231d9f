import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from postsift.session import get_spark
    ck = tempfile.mkdtemp(prefix="postsift-test-ckpt-")
    s = get_spark("local[4]", app="postsift-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ck})
    yield s
    s.stop()
