import pytest


@pytest.fixture(scope="module")
def spark(spark):
    """The session of the other tests, with splits of the usual size while a module of these runs."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    spark.conf.set("spark.sql.files.openCostInBytes", "4m")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)
