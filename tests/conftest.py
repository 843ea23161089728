import os, sys  # noqa: E401

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskbench.session import build_session

    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_ranges(monkeypatch):
    """Cut groups into ranges of forty rows, so that small fixtures take the path of large groups."""
    from riskbench.functions import ordering

    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 40)


@pytest.fixture(scope="session")
def scored(spark):
    """Predictions of sf0.001 with many distinct scores and one score held by a third of the rows."""
    from pyspark.sql import functions as F

    from riskbench.sources import driver_tables as D

    s = D.scores(spark, SF)
    k = F.col("record_id")
    p = F.when(k % 3 == 0, 0.5).otherwise(F.col("p_a") * 0.9 + (k * 7919 % 1000) / 10000.0)
    rows = s.select("record_id", F.col("cardio").alias("y"), p.alias("p"), (k % 2).cast("int").alias("g")).toPandas()
    return spark.createDataFrame(rows), rows
