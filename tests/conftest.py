import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

os.environ.setdefault("SHUFFLE_PARTITIONS", "2")

from restartlab.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, "restartlab-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
