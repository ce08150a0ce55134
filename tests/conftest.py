import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = Path(os.environ.get("GRIDSPARK_TEST_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from gridspark.session import build_session

    s = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__default__parallelism="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    d = DATA / "sf0.001"
    if not d.exists():
        pytest.skip("no test data here")
    return str(d)
