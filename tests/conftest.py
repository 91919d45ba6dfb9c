import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, memory="6g", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
