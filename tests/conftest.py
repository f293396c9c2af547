import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Rows of JSON texts as nested posts."""
    import json

    from postmill.functions.posts import parse_post
    from pyspark.sql import functions as F

    def make(*posts):
        rows = [(p if isinstance(p, str) else json.dumps(p),) for p in posts]
        return spark.createDataFrame(rows, "value string").select(
            "value", parse_post(F.col("value")).alias("p")
        ).select("value", "p.*")

    return make
