import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]
from celldays.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    yield s
    s.stop()
