import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    made = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def made(rows, extra=""):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *more) for i, t, *more in rows], DOCS + extra)

    return made
