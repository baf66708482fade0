from __future__ import annotations

import pytest

from quaestor.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.streaming.stateStore.stateSchemaCheck": "true",
    }
    session = build_session("tests", "local[8]", shuffle_partitions=8, **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
