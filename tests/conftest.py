import pytest
from pyspark.sql import SparkSession

from runframe import configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield configure(session)
    session.stop()


@pytest.fixture
def hot(spark):
    """Every group counts as too large for one task, and partitions stay apart."""
    spark.conf.set("spark.runframe.hotGroupRows", "0")
    spark.conf.set("spark.runframe.hotGroupParts", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.runframe.hotGroupRows")
    spark.conf.unset("spark.runframe.hotGroupParts")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
