import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
