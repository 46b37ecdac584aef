"""One local session for all tests; the checkpoint folder is temporary."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gaugewright.session import get_session

    session = get_session(
        "tests", os.environ.get("TEST_MASTER", "local[4]"), **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
