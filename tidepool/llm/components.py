"""Connected components of an edge table by alternating large-star and small-star steps.

Each step takes every node's smallest neighbour with a map-side-combined aggregate
and re-hangs edges onto it with an equi-join; no neighbourhood is gathered in one
place, so a hub is only a skewed join key.  The number of rounds grows with the
logarithm of the longest path.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import materialize


def _min_neighbour(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of a node are hung onto its smallest neighbour (or itself)."""
    arcs = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _min_neighbour(arcs).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    up = arcs.where("v > u").join(m, F.col("u") == F.col("c"))
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung onto the smallest of them."""
    m = _min_neighbour(e).select(F.col("u").alias("c"), "m")
    down = e.join(m, F.col("u") == F.col("c"))
    hung = down.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return hung.unionAll(m.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge but the roots; ``root`` is the component's smallest node.

    Self-loops and repeated edges do not matter; NULL ends are ignored.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        e = materialize(_small_star(_large_star(e)), "stars")
