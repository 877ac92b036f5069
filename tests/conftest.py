import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reelspark.session import EngineConfig, get_session  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = get_session(EngineConfig(app_name="tests", master="local[*]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}))
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
