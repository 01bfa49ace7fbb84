import pytest
from pyspark.sql import SparkSession

from tidemark.session import SETTINGS


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    settings = SETTINGS | {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    builder = SparkSession.builder.master("local[4]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
