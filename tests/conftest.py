import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from warraq.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    return s
