"""Connected components of an edge table, by neighbour minima and pointer jumping.

Defined results: edges with a null end and edges from a node to itself are left out;
repeated edges count once; a node without edges has no row; an empty table gives an
empty one; only columns a and b are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._io import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): label is the least node reachable.  ``edges`` has long columns a and b.

    Rounds grow with the logarithm of the longest path; each is written to the
    scratch folder, so a lost executor costs at most one round.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct()
    both = scratch.stored(both, "edges")
    labels = scratch.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        # each node offers its label to its neighbours; one row per target after the partial minimum
        offered = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        nearer = labels.join(offered, "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("was"))
        jump = nearer.join(labels.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
        new = scratch.stored(jump.select("node", F.least("label", F.coalesce("root", "label")).alias("label"), "was"), "labels")
        labels = new.select("node", "label")
        if new.where("label != was").isEmpty():
            return labels
