import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tenderlens.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Values of a column function for a list of inputs."""
    from pyspark.sql import functions as F

    def run(function, inputs, kind="string"):
        rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, v {kind}")
        return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]

    return run
