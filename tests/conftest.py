import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sparkcast.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="sparkcast-tests", shuffle_partitions=4)
    checkpoint_dir(s)  # tests only: a private temp folder when the cluster names none
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="sparkcast-test-")
