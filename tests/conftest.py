import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tapline.session import get_spark
    s = get_spark("local[*]", app="tapline-tests", shuffle_partitions=8,
                  extra={"spark.driver.memory": "8g"})
    yield s


@pytest.fixture(scope="session")
def duck():
    from tapline.plans.check import duck_connect
    return duck_connect(SF_CHECK)
