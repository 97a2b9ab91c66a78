"""Connected components by contraction: every round hooks each node to its smallest neighbour, follows the hooks to their roots, and goes
on with the links between roots. Nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra.session import materialize


def follow(hooks: DataFrame) -> DataFrame:
    """hooks (node, up), up < node or a root's own: the same with each node's root, by pointer doubling."""
    while True:
        up = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
        hooks = materialize(hooks.join(up, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "hooks")
        if hooks.filter("moved").isEmpty():
            return hooks.select("node", "up")
        hooks = hooks.select("node", "up")


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b). Gives (node, component) for every node of a link, component being the smallest node reachable.

    Repeated links, both directions and links of a node to itself are fine; a table without links gives no rows.
    """
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    found = None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up"))
        hooks = follow(materialize(hooks, "hooks"))
        if found is None:
            found = hooks.select("node", F.col("up").alias("component"))
        else:
            found = found.join(hooks.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        found = materialize(found, "components")
        a, b = (hooks.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in "ab")
        links = links.join(a, "a").join(b, "b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
        links = materialize(links.filter("a <> b").distinct(), "links")
        if links.isEmpty():
            return found
