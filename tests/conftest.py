import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from kestrel.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s


def vec_frame(spark, rows, dim=None):
    """(id, embedding) frame from python lists."""
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows],
                                 "id long, embedding array<float>")
