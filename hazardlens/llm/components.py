"""Connected components of an edge table, by repeated hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.io import Stash


def labels(edges: DataFrame, stash: Stash) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (``a``, ``b`` long): label is the component's smallest node.

    Each round every node hooks on its smallest neighbour if that is smaller, trees are flattened by pointer jumping,
    and edges are rewritten to labels; all steps are aggregations and joins, so nothing is gathered in one place.
    """
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    left = stash.keep(both, "edges")
    label = None
    while left.count():
        links = left.groupBy("hi").agg(F.min("lo").alias("lo"))
        up = stash.keep(links.select(F.col("hi").alias("node"), F.col("lo").alias("to")), "up")
        while True:
            parent = up.select(F.col("node").alias("to"), F.col("to").alias("top"))
            jumped = stash.keep(
                up.join(parent, "to", "left").select("node", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")), "up"
            )
            stash.drop(up)
            up = jumped
            if not up.filter("moved").limit(1).count():
                break
        step = up.select("node", F.col("to").alias("label"))
        if label is None:
            new = step
        else:
            old = label.select(F.col("node").alias("first"), F.col("label").alias("node"))
            new = old.join(step, "node", "left").select(F.col("first").alias("node"), F.coalesce("label", "node").alias("label"))
            new = new.unionByName(step.join(label.select("node"), "node", "left_anti"))
        kept = stash.keep(new, "labels")
        move = lambda side: step.select(F.col("node").alias(side), F.col("label").alias(f"{side}_to"))  # noqa: B023, E731
        moved = left.join(move("hi"), "hi", "left").join(move("lo"), "lo", "left")
        a, b = F.coalesce("hi_to", "hi"), F.coalesce("lo_to", "lo")
        moved = moved.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
        rest = stash.keep(moved, "edges")
        stash.drop(left, up, *([label] if label is not None else []))
        left, label = rest, kept
    if label is None:
        label = stash.keep(left.select(F.col("hi").alias("node"), F.col("lo").alias("label")), "labels")
    roots = label.select(F.col("label").alias("node")).distinct()
    return label.unionByName(roots.select("node", F.col("node").alias("label")).join(label.select("node"), "node", "left_anti"))
