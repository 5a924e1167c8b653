import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Builds a files table from {path: text}, all in repository `r` unless the path is (repo, path)."""
    from vulnloom.sources.files import as_files

    def build(texts: dict) -> DataFrame:
        rows = [((*k, v) if isinstance(k, tuple) else ("r", k, v)) for k, v in texts.items()]
        return as_files(spark.createDataFrame(rows, "repo_id string, relative_path string, content string"))

    return build
