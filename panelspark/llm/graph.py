"""Connected components of a link table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node it reaches) for every node of ``links`` (columns ``a`` and ``b``).

    Every node points to a parent; each round takes the least grandparent among a node and its neighbours for
    the node and for its parent, and skips one step on the way up, so long chains halve.  Rounds are tables in
    the shared folder; only whether anything changed reaches the driver.  Minima are summed before the
    shuffle, and the joins are plain ones, which the engine splits where a parent has very many children.
    Links of a node to itself and repeated links do no harm; links with a NULL end are left out.
    """
    pairs = links.select("a", "b").where("a != b")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    up = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("parent")), "labels")
    while True:
        parents = up.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        reach = up.select("node", "parent").join(parents, "parent")
        near = (both.join(reach.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("m")))
        seen = reach.join(near, "node").withColumn("m", F.least("m", "grand"))
        offers = (seen.select("node", F.least("parent", "m").alias("p"), F.col("parent").alias("old"))
                  .unionByName(seen.select(F.col("parent").alias("node"), F.col("m").alias("p"), F.lit(None).cast("long").alias("old"))))
        up = cut_lineage(offers.groupBy("node").agg(F.min("p").alias("parent"), F.max("old").alias("old")), "labels")
        if up.where("parent != old").isEmpty():
            return up.select("node", F.col("parent").alias("label"))
