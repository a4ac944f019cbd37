import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def make_session(cores: int = 8):
    from pyspark.sql import SparkSession

    from tidemark.session import BUILD_CONF, RUN_CONF

    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark-tests")
    conf = {**BUILD_CONF, **RUN_CONF, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
