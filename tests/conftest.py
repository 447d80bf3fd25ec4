import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from preflens.frames import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", **{"spark.ui.showConsoleProgress": "false",
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
