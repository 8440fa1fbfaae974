"""Connected components over an edge table, by hash-to-min propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinolake.operators.scale import cut


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for edges (a, b): the component is its smallest node.

    Each round every node takes the least label among its own and its
    neighbours', then the label of its label; the number of rounds is about the
    logarithm of the longest path. Lineage is cut each round by a reliable
    checkpoint. Self-loops make single nodes; null ends are left out; repeated
    edges change nothing; no edges give no rows. Nothing but one changed-rows
    count per round reaches the driver.
    """
    clean = edges.select("a", "b").where("a is not null and b is not null")
    both = cut(clean.union(clean.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(rounds):
        offered = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n2")).agg(F.min("component").alias("offer"))
        met = labels.join(offered, F.col("node") == F.col("n2")).select("node", F.col("component").alias("old"), F.least("component", "offer").alias("component"))
        jump = met.alias("m").join(met.select(F.col("node").alias("at"), F.col("component").alias("up")), F.col("m.component") == F.col("at")).select("m.node", "m.old", F.least("m.component", "up").alias("component"))
        new = cut(jump)
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels
