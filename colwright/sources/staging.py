"""Tables written once and read several times.

Staged tables live under the folder the cluster names in ``spark.checkpoint.dir``,
so they survive the loss of any executor, and later passes read only the columns
they need.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a bare local session may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
    return tempfile.gettempdir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/colwright-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def release(table: DataFrame) -> None:
    """Remove a staged table that nothing will read again."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.staged_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of ended jobs removed. Spark does so once the driver's JVM has collected the
    plans that refer to them, which with little going on in the driver may take until long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
