"""Connected components of a link table, kept distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _compressed(parents: DataFrame) -> DataFrame:
    """node, root of a forest (node, root): pointers are doubled until none moves."""
    while True:
        ahead = parents.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = materialize(parents.join(ahead, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "roots")
        discard(parents)
        parents = moved
        if not moved.where("moved").limit(1).count():
            return moved


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: every node that has a link, with the smallest node it reaches.

    In each round every node hooks to its smallest neighbour, the trees are compressed to their
    roots, and links are redrawn between roots; those within a tree are gone. At least half of
    the linked nodes vanish in a round, so rounds grow with the logarithm of the nodes, and the
    links that move shrink with them. Each step is written to the shared folder; only whether
    anything is left reaches the driver.
    """

    def drawn(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    left, maps = drawn(links.select("a", "b")), []
    while not maps or left.limit(1).count():
        hooked = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        roots = _compressed(materialize(hooked.select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hooked"))
        maps.append(roots)
        ends = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        redrawn = drawn(left.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(ends, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        discard(left)
        left = redrawn
    out = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        whole = materialize(out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        discard(out, later)
        out = whole
    discard(left)
    return out.select("node", "root")
