import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from policylens.schema import POLICY, REQUEST  # noqa: E402
from policylens.session import local_session  # noqa: E402
from tables import FIVE, LABELS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, app="tests", memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def five(spark):
    return spark.createDataFrame(FIVE, REQUEST)


@pytest.fixture(scope="session")
def five_labelled(spark):
    return spark.createDataFrame([(*row, y) for row, y in zip(FIVE, LABELS)], POLICY)
