import os
import sys

import pytest

# numpy's BLAS threads can hang in a process that has forked, as pyspark does to start the JVM
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from newsloom.session import get_spark
    s = get_spark("local[4]", 8, app="newsloom-tests")
    yield s
    s.stop()
