"""Connected components by contraction, for edges that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(node, component) of all ends of ``edges`` (a, b); a component is named by its smallest node.

    Each round every node goes to the smallest of itself and its neighbours and the edges between
    what remains are kept, once each. Minima are taken on the map side first, so a node with very
    many neighbours costs one row a task; the joins may be split where a node is frequent.
    """
    edges = scratch.cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    done: DataFrame | None = None
    k = 0
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), f"{name}-step{k}")
        to_a, to_b = (step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = edges.join(to_a, "a").join(to_b, "b").filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        after = scratch.cut(moved, f"{name}-edges{k + 1}")
        if done is None:
            now = step.select("node", F.col("to").alias("component"))
        else:
            link = step.select(F.col("node").alias("component"), F.col("to").alias("_to"))
            now = done.join(link, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        done = scratch.cut(now, f"{name}-map{k}")
        scratch.drop(f"{name}-edges{k}", f"{name}-step{k}", *([f"{name}-map{k - 1}"] if k else []))
        edges = after
        k += 1
    return done if done is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
