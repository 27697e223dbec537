import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lineitem(spark):
    return spark.read.parquet(f"{SMALL}/lineitem.parquet")


@pytest.fixture(scope="session")
def events(spark):
    return spark.read.parquet(f"{SMALL}/events.parquet")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, NaN, constants, all-missing, booleans, ties and hot values in a few rows."""
    nan = float("nan")
    rows = [
        (1, 1.0, 5.0, None, True, "a", "1", " NA "),
        (2, 2.0, 5.0, None, False, "a", "2", "x"),
        (3, nan, 5.0, None, True, "b", "3.5", "?"),
        (4, 4.0, 5.0, None, None, None, "-4", "unknown"),
        (5, 100.0, 5.0, None, True, "a", None, "N/A"),
        (6, None, 5.0, None, True, "a", "6", ""),
        (7, 2.0, 5.0, None, True, "c", "7", None),
        (8, 2.0, 5.0, None, True, "a", "8", "none"),
    ]
    return spark.createDataFrame(
        rows, "id long, x double, flat double, gone double, flag boolean, cat string, num_text string, tok string")
