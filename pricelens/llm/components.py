"""Connected components of a graph given as an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SALTS = 16


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b).

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label, so
    distances halve; rounds end when nothing changes. Labels of each round are a table in the shared folder. A node with
    many neighbours only adds to partial minima, and a label that many nodes have is looked up in SALTS parts.
    """
    both = written(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("near"))
        near = near.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        asked = near.select("near", "salt").distinct()
        roots = asked.join(labels.select(F.col("node").alias("near"), F.col("component").alias("root")), "near")
        after = written(spark, near.join(roots, ["near", "salt"]).select("node", "old", F.least("near", "root").alias("component")), "labels")
        changed = after.filter(F.col("old") != F.col("component")).limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
