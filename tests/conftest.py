import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests")
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def table(spark):
    """Build a table from rows and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
