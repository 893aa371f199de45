import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from steplake.session import get_session

    session = get_session("tests", "local[8]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def folder(spark, tmp_path):
    """A fresh folder for what a test writes; tests run on one machine."""
    return str(tmp_path)
