from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kelda.session import build_session

    s = build_session("local[4]", "tests", 4, **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return "/root/testdata/sf0.001"
