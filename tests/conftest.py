from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tierline.session import ensure_session

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tierline-test-"))
    ensure_session(s)
    yield s
    s.stop()


def ts(h: int, m: int = 0, day: int = 1) -> dt.datetime:
    """Hourly instants from 2026-01-01 00:00 (naive, read as UTC)."""
    return dt.datetime(2026, 1, day, h, m)


@pytest.fixture
def tmp_dir(spark):
    from tierline.session import fresh_dir

    return fresh_dir(spark, "test")
