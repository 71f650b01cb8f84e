import os
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("afluente-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="/tmp/run-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder_of():
    """Write named Latin-1 files into a fresh folder."""

    def make(files: dict[str, str | bytes]) -> str:
        place = tempfile.mkdtemp(prefix="/tmp/run-")
        for name, content in files.items():
            data = content if isinstance(content, bytes) else content.encode("latin-1")
            with open(os.path.join(place, name), "wb") as out:
                out.write(data)
        return place

    return make
