"""Session settings the library relies on."""

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "bourse") -> SparkSession:
    """A session for tests and the bench; on a cluster the job's own session is used."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BOURSE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def written(df: DataFrame, name: str, by=()) -> DataFrame:
    """A table that is read more than once: written to the shared folder and read back, so nothing has to be released.

    Its files are cut by the columns `by`, of a handful of values each.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@cache
def _own_folder(app: str) -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix=f"bourse-{app}-", ignore_cleanup_errors=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, else the context's own.

    Where neither is set a local session gets a folder that goes with its process; a cluster has to name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder(context.applicationId).name
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder
