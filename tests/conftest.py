import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from turnstile import session  # noqa: E402

SF = os.environ.get("TURNSTILE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session.build("8")
    session.ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from check import connect

    return connect(SF)


@pytest.fixture(scope="session")
def sf():
    return SF
