"""Distributed union-find over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, parts
from ._common import stored as written

#: Tasks that write a small table, and links for each task of a larger one.
TASKS, PART_LINKS = 8, 50_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a long, b long); component is the smallest id reachable.

    Union-find by hooking and contraction: every root hooks to its smallest neighbour if that is smaller, paths are
    halved, and links move to the parents; equal ends vanish.  Each step is a join and a pre-aggregated minimum over the
    remaining links, so a hub costs one row per task, and lineage is cut by written tables.  Self-links, repeated and
    reversed links are harmless; an empty table gives an empty table.
    """
    ends = links.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    tasks = max(TASKS, parts(ends.count(), PART_LINKS))
    stored = lambda df, name: written(df.coalesce(tasks), name)
    ids = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    parent = stored(ids.select("id", F.col("id").alias("p")), "uf-parent")
    edge = stored(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "uf-edge")
    while not edge.isEmpty():
        # smaller neighbour of each vertex, pre-aggregated in every task
        hook = edge.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("h"))
        # only roots hook; the links of other vertices move up to their parents below
        hooked = parent.join(hook, "id", "left").select("id", F.when(F.col("p") == F.col("id"), F.coalesce("h", "p")).otherwise(F.col("p")).alias("p"))
        hooked = stored(hooked, "uf-hook")
        half = hooked.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        jumped = stored(hooked.join(half, "p").select("id", F.col("pp").alias("p")), "uf-parent")
        up_a = jumped.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        up_b = jumped.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        moved = edge.join(up_a, "a").join(up_b, "b").where("pa <> pb")
        moved = moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        moved = stored(moved, "uf-edge")
        for old in (parent, edge, hooked):
            discard(old)
        parent, edge = jumped, moved
    while True:
        half = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        jumped = stored(parent.join(half, "p").select("id", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "uf-root")
        discard(parent)
        parent = jumped.select("id", "p")
        if jumped.where("moved").isEmpty():
            return parent.withColumnRenamed("p", "component")
        parent._meanfield_path = jumped._meanfield_path
