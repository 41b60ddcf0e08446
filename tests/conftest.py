import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import ensure_checkpoint_dir, get_session

    s = get_session(master="local[*]", shuffle_partitions=8)
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
