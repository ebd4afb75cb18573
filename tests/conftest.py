from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from revlens.session import configure

    s = (
        SparkSession.builder.master("local[4]")
        .appName("revlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # tests only: the cluster names its own shared checkpoint folder
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="revlens-test-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s
    s.stop()
