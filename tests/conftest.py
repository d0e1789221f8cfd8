"""One small session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from skeinlog import build_session

    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions=4, spark__driver__memory="3g", spark__default__parallelism=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
