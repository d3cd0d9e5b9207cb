"""Connected components by repeated contraction, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows those pointers twice and replaces the
    edges by edges between the targets. Minima are found by partially aggregated groupBys and pointers are
    followed by sort-merge joins that adaptive execution can split, so that a hub or a component with a
    third of all nodes doesn't land in one task. Every table between rounds is written to the shared folder and
    deleted once the tables made from it are written.
    Self loops, null ends and repeated edges have no effect; no edges give no rows.
    """
    # Materialised before the loop; each round reads a table, never the lineage of all earlier rounds.
    cur = saved(_canonical(edges.select("a", "b")), "edges")
    assigned: DataFrame | None = None
    for _ in range(max_rounds):
        if cur.isEmpty():
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        first = parent = saved(parent, "parents")
        for _ in range(2):
            hop = parent.select(F.col("node").alias("to"), F.col("to").alias("next"))
            parent = parent.join(hop, "to").select("node", F.col("next").alias("to"))
        parent, last, before = saved(parent, "pointers"), cur, assigned
        forget(first)
        if assigned is None:
            assigned = parent.select("node", F.col("to").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), F.col("to").alias("next"))
            assigned = assigned.join(step, "component", "left").select(
                "node", F.coalesce("next", "component").alias("component")
            )
        assigned = saved(assigned, "assigned")
        left = parent.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        right = parent.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        cur = saved(
            _canonical(cur.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))),
            "edges",
        )
        forget(parent, last, before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if assigned is None:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return assigned


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
