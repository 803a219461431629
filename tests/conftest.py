import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PIXELLOOM_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from pixelloom.session import build_session

    session = build_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session
