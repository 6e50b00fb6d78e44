import pytest
from pyspark.sql import SparkSession

from runledger.session import configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    return configure(session)
