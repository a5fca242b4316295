import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.runtime import session, workers_import

    s = session("tests", cpus="4", shuffle_partitions=4)
    workers_import(s)
    yield s
    s.stop()
