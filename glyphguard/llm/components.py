"""Connected components of a links table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every id that has a link; root is the smallest id reachable.

    Each round takes the least root among a node's neighbours (a pre-aggregated minimum, so a hub
    costs no more than its rows), then jumps to that root's root, which halves long chains. A round
    is a written table, so a lost executor costs a round at most.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = cut(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "id"), "labels")
    while True:
        near = edges.join(labels, edges.v == labels.id).groupBy("u").agg(F.min("root").alias("near"))
        least = labels.join(near, labels.id == near.u, "left").select(
            "id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")
        )
        jump = labels.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        new = cut(
            least.join(jump, F.col("root") == F.col("_id"), "left").select(
                "id", "old", F.least("root", F.coalesce("_root", "root")).alias("root")
            ),
            "labels",
        )
        drop_cut(labels)
        moved = new.filter("old <> root").limit(1).count()
        labels, path = new.select("id", "root"), new._glyphguard_path
        labels._glyphguard_path = path
        if not moved:
            drop_cut(edges)
            return labels
