import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staged")))
        # shuffle files go only once the driver has collected what refers to them
        .config("spark.cleaner.periodicGC.interval", "30s")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def run(spark):
    """Each module's staged tables and caches go with it."""
    import facsimile
    from catalog import inputs

    with facsimile.run(spark):
        yield
    inputs.forget()
    spark.sparkContext._jvm.System.gc()
