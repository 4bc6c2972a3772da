import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from hypnolake.session import build_session

    s = build_session(
        "local[8]", "hypnolake-tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(params=["calm", "hot"])
def mode(request, monkeypatch):
    """Run a test with whole recordings and again with every recording cut into chunks."""
    from hypnolake.operators import ordered

    if request.param == "hot":
        monkeypatch.setattr(ordered, "HOT_ROWS", 5)
    return request.param
