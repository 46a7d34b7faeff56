"""Local Spark session for checks and benchmarks."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str = "8") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("colwright")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # A cluster names its own shared folder; only a bare local session gets one here.
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="colwright-"))
    return spark
