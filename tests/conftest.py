import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from warywire.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session("8", **{"spark.checkpoint.dir": folder, "spark.warywire.rounds.divisor": "50"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "message_id long, message_text string")
