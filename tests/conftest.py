import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallysheaf.plans.session import tune

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        # Tiny splits: a file of a few lines spans several tasks, as a large one does.
        .config("spark.sql.files.maxPartitionBytes", "64").config("spark.sql.files.openCostInBytes", "1").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


@pytest.fixture
def make(spark):
    """A table from rows, in row order; names ending in __raw are companions."""
    from pyspark.sql import functions as F

    from tallysheaf.table import Table

    def build(schema, rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pos int, {schema}")
        boxes = {n: f"{n}__raw" for n in df.columns if f"{n}__raw" in df.columns}
        table = Table.of(df.drop("pos").limit(0), boxes=boxes)
        placed = Table.of(df, position=[F.col("pos")])
        return table.with_df(placed.df.drop("pos"), order=placed.order)

    return build
