"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the component's smallest node.

    Each round points every node's larger neighbours at its smallest one, then every node's
    smaller neighbours, until the links form stars; the number of rounds grows with the
    logarithm of the components' sizes. Each round's links are written to the shared folder.
    Joins are merged: a broadcast in each round costs the driver far more memory than its rows.
    Links with a null end and links of a node to itself add nothing; no links, no rows.
    """
    a, b = F.col("a"), F.col("b")
    found = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), a.isNotNull().alias("x"), b.isNotNull().alias("y"))
    edges = materialise(found.filter("x AND y AND a <> b").select("a", "b").distinct(), "links")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        last, edges = edges, materialise(_small_star(_large_star(edges)), "links")
        discard(last)
        state, before = _state(edges), state
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(a.alias("node"), b.alias("root")).union(edges.select(b, b).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").union(least.select("a", "m")).distinct()
