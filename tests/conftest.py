import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))

import pytest  # noqa: E402

from trapline.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
