import pandas as pd
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("wordloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


MICRO = [
    (1, "Green energy, green jobs."),
    (2, "The energy market: the green market"),
    (3, "The café market report 2024"),
    (4, "the the the end"),
    (5, ""),
    (6, "The market, the report"),
    (7, "Energy green and energy green green"),
    (8, "the Old town"),
]


@pytest.fixture(scope="session")
def micro_texts(spark):
    return spark.createDataFrame(pd.DataFrame(MICRO, columns=["text_id", "text"]))


@pytest.fixture(scope="session")
def micro_index(spark, micro_texts, tmp_path_factory):
    from wordloom import write_index

    return write_index(micro_texts, str(tmp_path_factory.mktemp("micro") / "index"), bins=7)


@pytest.fixture
def ask(spark):
    def requests(*texts):
        rows = pd.DataFrame({"query_id": range(len(texts)), "request": texts})
        return spark.createDataFrame(rows, "query_id long, request string")

    return requests
