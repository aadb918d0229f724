"""Distributed connected components by repeated contraction.

Each round every node hooks onto its smallest neighbour, edges are renamed to their ends'
parents, and loops and repeats are dropped. Only nodes smaller than all neighbours stay, so
at least half of the nodes that still have edges go each round. No neighbour list is ever
collected: the rounds are partial aggregates and sort-merge joins, whose hot keys Spark's
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of each node.

    ``edges`` has columns ``a`` and ``b`` (long). Null ends and loops are ignored, repeated
    and reversed edges count once. Returns ``node``, ``root`` for every node that has an
    edge to another node; an empty input gives an empty result.
    """
    edges = materialize(_clean(edges), "edges")
    parents: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        ends = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(
            ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("parent")),
            "parents",
        )
        parent = _shortcut(parent)
        parents.append(parent)
        edges = materialize(_clean(_rename(_rename(edges, parent, "a"), parent, "b")), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = parents[0].select("node", F.col("parent").alias("root"))
    for parent in parents[1:]:
        found = materialize(_rename(found, parent, "root"), "roots")
    return found


def _shortcut(parent: DataFrame) -> DataFrame:
    """Follow parents until every node points to one that is its own parent."""
    while True:
        up = parent.select(F.col("node").alias("k"), F.col("parent").alias("up"))
        nxt = materialize(
            parent.join(up, parent["parent"] == up["k"]).select("node", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")),
            "parents",
        )
        moved = not nxt.where("moved").isEmpty()
        parent = nxt.select("node", "parent")
        if not moved:
            return parent


def _rename(df: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its parent; values without one stay."""
    up = parent.select(F.col("node").alias("_k"), F.col("parent").alias("_up"))
    rest = [c for c in df.columns if c != column]
    return df.join(up, df[column] == up["_k"], "left").select(*rest, F.coalesce("_up", column).alias(column))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
