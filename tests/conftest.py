import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from celloom.session import local_session

    session = local_session(int(os.environ.get("TEST_CPUS", "8")), **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
