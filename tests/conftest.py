import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vinolake.session import local, ship

    s = local(4, "4g", 4)
    ship(s)
    return s
