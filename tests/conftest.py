import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from harness import DATA, make_duckdb, make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture(scope="session")
def small_dir():
    return DATA / "sf0.001"


@pytest.fixture(scope="session")
def small_duckdb(small_dir):
    return make_duckdb(small_dir)
