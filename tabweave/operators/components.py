"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star rounds (Kiryat et al. 2014, "Connected
Components in MapReduce and Beyond"): each round is two aggregations and two
equi-joins, no node ever gathers its neighbours in one place, and the number of
rounds grows with the logarithm of the graph.  Lineage is cut every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("m"))
    ties = down.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return ties.union(low.select("src", F.col("m").alias("dst")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").distinct()


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``; a component is named by its smallest ``id``.

    ``vertices`` has ``id``, ``edges`` has ``src`` and ``dst`` of the same type.
    """
    # A round is a few passes over the edges alone: not more partitions than can run at once twice over.
    parts = 2 * edges.sparkSession.sparkContext.defaultParallelism
    state, seen = cut_lineage(_tidy(edges).coalesce(parts)), None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        # The large star gives at most one row per edge, so copies may wait until the small star is done.
        state = cut_lineage(_tidy(_small_star(_large_star(state).where("src <> dst"))).coalesce(parts))
    roots = state.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("component"))
    return vertices.select("id").join(roots, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
