"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.core.session import cut


#: Edge tables of so many rows, both directions counted, have their labels broadcast and lie in few files.
FEW_EDGES = 400_000
FILE_EDGES = 100_000


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected edge table with the smallest node it reaches.

    Minimum labels spread along edges and then jump to their own label's label, so a chain of
    length n takes about log n rounds. Each round is one join and one map-side combined
    aggregation, cut by a checkpoint; nothing is collected. Edge tables counted to be few have
    their labels broadcast; there a round has at most one shuffle. Edges with a null end are
    ignored. An empty edge table gives an empty result. Returns ``node, component``.
    """
    both = edges.select(F.col(left).alias("node"), F.col(right).alias("peer")).where(
        "node is not null and peer is not null and node <> peer"
    )
    both = cut(both.unionByName(both.select(F.col("peer").alias("node"), F.col("node").alias("peer"))).distinct())
    n = both.count()

    def near(df: DataFrame) -> DataFrame:
        """Rows a node: no more than edges."""
        return F.broadcast(df) if n <= FEW_EDGES else df

    def packed(df: DataFrame) -> DataFrame:
        return df.coalesce(1 + n // FILE_EDGES) if n <= FEW_EDGES else df

    both = packed(both)
    labels = cut(packed(both.groupBy("node").agg(F.least(F.min("peer"), F.first("node")).alias("component"))))
    for _ in range(max_rounds):
        heard = (
            both.join(near(labels.select(F.col("node").alias("peer"), "component")), "peer")
            .groupBy("node")
            .agg(F.min("component").alias("heard"))
        )
        spread = labels.join(near(heard), "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", "heard").alias("component")
        )
        roots = near(labels.select(F.col("node").alias("root"), F.col("component").alias("root_component")))
        jumped = cut(
            packed(
                spread.join(roots, F.col("component") == F.col("root"), "left").select(
                    "node", "old", F.least("component", "root_component").alias("component")
                )
            )
        )
        done = jumped.where("old <> component").isEmpty()
        labels = jumped.drop("old")
        if done:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
