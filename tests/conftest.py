import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codeweave.session import get_spark
    s = get_spark(cpus=4, shuffle_partitions=4, app="codeweave-tests")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    yield s


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
