"""Connected components of an edge table by repeated contraction.

Each round points every vertex at its smallest neighbour, follows the pointers to
their end, and rewrites the edges between the ends; edges inside one vanish. Every tree of
pointers has two vertices or more, so a round at least halves the vertices, whatever the shape
of the graph. Only minimum aggregations and equi-joins are used, so a star with a third of
all rows combines on the map side and its join is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle


def contract(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex that has an edge; component is its smallest vertex."""
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    live = settle(pair.distinct())
    steps = []
    while not live.isEmpty():
        near = roots(live)
        steps.append(near)
        a = near.select(F.col("id").alias("src"), F.col("root").alias("a"))
        b = near.select(F.col("id").alias("dst"), F.col("root").alias("b"))
        moved = live.join(a, "src").join(b, "dst").where("a <> b")
        live = settle(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    if not steps:
        return live.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    # from the last step, the smallest, back to the first: each join is as large as its own step
    labels = steps[-1]
    for step in reversed(steps[:-1]):
        nxt = labels.select(F.col("id").alias("root"), F.col("root").alias("above"))
        labels = step.join(nxt, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
    smallest = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(smallest, "root").select("id", "component")


def roots(live: DataFrame) -> DataFrame:
    """(id, root): every vertex follows smallest neighbours to the end of its chain.

    Such a chain ends in two vertices that are each other's smallest neighbour; the smaller is the root. Pointers are
    doubled until none moves, so a chain of any length takes the logarithm of its length.
    """
    both = live.union(live.select("dst", "src"))
    picked = settle(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("low")))
    back = picked.select(F.col("id").alias("low"), F.col("low").alias("again"))
    ends = (F.col("again") == F.col("id")) & (F.col("id") < F.col("low"))
    near = settle(picked.join(back, "low").select("id", F.when(ends, F.col("id")).otherwise(F.col("low")).alias("root")))
    while True:
        up = near.select(F.col("id").alias("root"), F.col("root").alias("above"))
        top = near.select(F.col("id").alias("above"), F.col("root").alias("top"))
        near = settle(near.join(up, "root").join(top, "above").select("id", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
        moved = not near.where("moved").isEmpty()
        near = near.select("id", "root")
        if not moved:
            return near


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex; isolated vertices are their own component."""
    labels = contract(edges)
    return vertices.select("id").join(labels, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))


def group_edges(df: DataFrame, id_col: str, columns: list[str], present) -> DataFrame:
    """One star per (column, value): every row is tied to the smallest id holding the value."""
    stars = None
    for name in columns:
        held = df.where(present(name)).select(F.col(id_col).alias("dst"), F.trim(F.col(name).cast("string")).alias("v"))
        hubs = held.groupBy("v").agg(F.min("dst").alias("src"))
        star = held.join(hubs, "v").where("src <> dst").select("src", "dst")
        stars = star if stars is None else stars.union(star)
    return stars
