"""Connected components as DataFrame rounds: least label of the neighbours, then of the label.

Edges and labels stay distributed. Each round writes its labels to the shared folder, so
lineage stays short and a lost executor costs one round at most. A node with very many
edges makes many join rows but only one partial sum a task, and joins on it are equi-joins
that adaptive execution splits. Taking the label of the label halves the distance to the
root, so rounds grow with the logarithm of a component's diameter; the first two rounds,
after which stars are done, go without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

STAR_ROUNDS = 2


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, distinct: bool = True) -> DataFrame:
    """(node, root) of each node that has an edge; root is the least node of its component.

    Null ends, edges from a node to itself and repeated edges do no harm; no edges give no rows. Where few
    edges repeat, distinct=False saves a shuffle of them.
    """
    spark = edges.sparkSession
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = ends.select("a", "b").union(ends.select("b", "a"))
    both = written(both.distinct() if distinct else both, "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "cc-labels")
    round_ = 0
    while True:
        round_ += 1
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("heard"))
        new = labels.join(heard, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        if round_ > STAR_ROUNDS:
            # the root's own label, which is at most the root itself
            above = new.select(F.col("node").alias("root"), F.col("root").alias("above"))
            new = new.join(above, "root", "left").select("node", "old", F.least("root", "above").alias("root"))
        new = written(new, "cc-labels")
        changed = not new.where("root < old").isEmpty()
        discard(spark, labels)
        labels = new.select("node", "root")
        if not changed:
            discard(spark, both)
            return labels
