from __future__ import annotations

import sys
import tempfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

AS_OF = datetime(2026, 3, 7, 12, 0, 0)


def make_session() -> SparkSession:
    from terraced import configure

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return make_session()


@pytest.fixture(scope="session")
def as_of() -> datetime:
    return AS_OF
