import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulse import session


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = session.build("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "6g", "spark.checkpoint.dir": folder,
        "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def scratch(spark):
    """Make fresh paths under the shared folder."""
    return lambda name: session.scratch_path(spark, name)


@pytest.fixture(scope="session")
def tables(spark):
    from pulse.sources.tables import Tables
    return Tables(spark, "/root/testdata/sf0.001")
