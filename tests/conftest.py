import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from kinelake.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("tests", cores="8", shuffle_partitions=8)
