"""A shared local session and the small driver tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TESTDATA = os.environ.get("INKMETER_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.default.parallelism", "4")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _data(name: str) -> str:
    path = f"{TESTDATA}/{name}"
    if not os.path.isdir(path):
        pytest.skip(f"{path} is not here")
    return path


@pytest.fixture(scope="session")
def tiny() -> str:
    return _data("sf0.001")


@pytest.fixture(scope="session")
def small() -> str:
    return _data("sf0.01")
