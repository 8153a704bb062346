import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from phrasemine.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        configure(SparkSession.builder)
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "2")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_lines(spark):
    def make(*lines):
        return spark.createDataFrame([(line,) for line in lines], "line string")

    return make


@pytest.fixture(scope="session")
def make_pairs(spark):
    """Parallel lines given as ``dst|src``."""
    from phrasemine.sources.parallel import parse_parallel

    def make(*values):
        raw = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "line_id int, value string")
        return parse_parallel(raw)

    return make
