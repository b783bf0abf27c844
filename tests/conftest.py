import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from rivulet.session import session

    out = session(cores=4, memory="4g")
    yield out
    out.stop()
