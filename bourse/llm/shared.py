"""What the operators of this package share: the cluster's folder, stored tables, safe column names."""

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


@cache
def _own_folder(app: str) -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix=f"llm-{app}-", ignore_cleanup_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in spark.checkpoint.dir, else the context's, else (in local sessions) an own one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or _own_folder(context.applicationId).name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends here, and a lost executor costs nothing before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def body(text: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(quoted(text), F.lit(""))


def with_own(df: DataFrame, **columns: Column) -> DataFrame:
    """Add an operator's columns last; input columns whose names clash with them (in any case) are replaced."""
    own = {c.lower() for c in columns}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in own], *[c.alias(n) for n, c in columns.items()])
