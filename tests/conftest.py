import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = os.environ.get("LOAM_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from loam.session import local_session

    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.01"
