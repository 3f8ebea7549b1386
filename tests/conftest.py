import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from siftline.session import tuned

    session = (
        SparkSession.builder.master("local[4]").appName("siftline-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield tuned(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a numbered DataFrame from a schema and rows."""

    def build(schema: str, *data):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "_row_id bigint, " + schema)

    return build
