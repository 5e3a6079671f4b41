"""Fixpoints over tables of links. Rounds are cut with checkpoint() in the session's shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourse.session import checkpoint_folder


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links reach, in any direction, from (a, b).

    Regions hook to the neighbouring region that comes first in the order of a hash, so that the pointers make short
    trees, and follow them once more; links between regions that became one disappear. The loop ends when none is left:
    no diameter is too large, and each round leaves a fraction of the regions.
    """
    checkpoint_folder(edges.sparkSession)
    live = edges.select("a", "b").distinct().checkpoint()
    labels = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    live = live.where("a <> b")

    def follow(df: DataFrame, c: str, hook: DataFrame) -> DataFrame:
        return df.join(hook.withColumnRenamed("region", c), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")

    def placed(c: str):
        return F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("name"))

    while not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_e")).select("_e.*")
        first = both.groupBy("a").agg(F.min(placed("b")).alias("_b"))
        hook = first.select(F.col("a").alias("region"), F.least(placed("a"), F.col("_b"))["name"].alias("into"))
        hook = hook.join(hook.select(F.col("region").alias("into"), F.col("into").alias("further")), "into").select("region", F.col("further").alias("into")).checkpoint()
        labels = follow(labels, "label", hook).select("node", "label")
        live = follow(follow(live, "a", hook), "b", hook).where("a <> b").select("a", "b").distinct().checkpoint()
    lowest = labels.groupBy("label").agg(F.min("node").alias("_low"))
    return labels.join(lowest, "label").select("node", F.col("_low").alias("label"))
