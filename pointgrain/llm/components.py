"""Connected components of a large graph by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrain.llm.common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (columns a, b): root is the smallest node of its component.

    Each round gives a node the least label among its own and its neighbours', then the label of that label, so the
    distance to the root shrinks by halves. A hub's labels meet in a partial aggregate, never in a list. Labels are
    checkpointed, so that a lost executor costs one round at most. Loops and repeated edges do no harm."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    label = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("of")).agg(F.min("root").alias("near"))
        lower = label.join(near, F.col("node") == F.col("of")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("next"))
        up = label.select(F.col("node").alias("at"), F.col("root").alias("above"))
        after = saved(lower.join(up, F.col("next") == F.col("at"), "left").select("node", "old", F.least("next", "above").alias("root")))
        label = after.select("node", "root")
        if after.where("old <> root").isEmpty():
            return label
