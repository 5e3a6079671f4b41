"""Connected components of a table of links, by contraction.

Each round hooks every node to the first of its neighbours in the order of a hash, and shortens the pointers by one
jump; links are then renamed to where their ends point, and those that became loops go. In a hash order pointers make
short trees whatever the names, so the nodes left shrink by a factor each round. A round is a few equality joins and
partially aggregated groupings, whatever the degree of a node, and its tables are written, so lineage stays short.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourse.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node in `links` (a, b): root is the smallest node that links reach from it.

    Repeated links, loops and either direction are fine; the loop runs until no link is left, whatever the diameter.
    """
    links = stored(links.select("a", "b").distinct(), "links")
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    roots = stored(ends.select("node", F.col("node").alias("root")), "roots")
    links = links.where("a <> b")
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
        hooks = stored(both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("from"), F.least(ranked("a"), F.col("m"))["node"].alias("to")), "hooks")
        jump = hooks.select(F.col("from").alias("to"), F.col("to").alias("far"))
        hooks = stored(hooks.join(jump, "to").select("from", F.col("far").alias("to")), "hooks")
        move = lambda df, c: df.join(hooks, df[c] == hooks["from"], "left").withColumn(c, F.coalesce("to", c)).drop("from", "to")  # noqa: E731, B023
        roots = stored(move(roots, "root"), "roots")
        links = stored(move(move(links, "a"), "b").where("a <> b").distinct(), "links")
    return roots.join(roots.groupBy("root").agg(F.min("node").alias("low")), "root").select("node", F.col("low").alias("root"))
