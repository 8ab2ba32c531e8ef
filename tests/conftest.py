import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from kestrel.session import build_session

    s = build_session("tests", "4", 4, "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
