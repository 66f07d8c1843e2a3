import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"
SMALL_LEDGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")

    def connect(sf_dir):
        con = duckdb.connect()
        for p in sorted(Path(sf_dir).glob("*.parquet")):
            con.sql(f"create view {p.stem} as select * from '{p}'")
        return con

    return connect
