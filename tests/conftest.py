import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from orderpulse.session import build_session, checkpoint_root

    s = build_session("local[4]", app_name="orderpulse-tests", shuffle_partitions=4,
                      extra={"spark.driver.memory": "4g"})
    # the environment's spark.checkpoint.dir when it names one; otherwise
    # checkpoint_root registers a fresh local folder (local master only)
    checkpoint_root(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from orderpulse.session import scratch_path

    return lambda name: scratch_path(spark, name)
