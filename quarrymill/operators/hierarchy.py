"""Recursive hierarchies: depth, explosion of a bill of materials, cycles."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels from which a walk looks out for cycles, and that it gathers before it cuts.
DEEP = 10


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage, so that plans don't grow with the levels. The session's checkpoint folder is used; a session of
    one machine without one gets a temporary folder, and a cluster has to name one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quarrymill-"))
    return df.checkpoint()


def _core(edges: DataFrame) -> DataFrame | None:
    """(id): nodes of ``edges(p, c)`` that lie on cycles or between them, None if there are none. Nodes without an edge
    in or out are peeled off until nothing changes."""
    left = edges.where("p is not null and c is not null").select("p", "c").distinct()
    n = left.count()
    while n:
        ends = left.join(left.select(F.col("p").alias("c")).distinct(), "c", "left_semi").join(left.select(F.col("c").alias("p")).distinct(), "p", "left_semi")
        left = _cut(ends.select("p", "c"))
        m = left.count()
        if m == n:
            return left.select(F.col("p").alias("id")).distinct()
        n = m
    return None


def _walk(at: DataFrame, edges: DataFrame, node: str, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``at``, level 1, and all levels that ``step(rows, level)`` makes of the one before, until one is empty. A walk
    along ``edges(p, c)`` that comes to a cycle would never end: that is a ValueError."""
    at = _cut(at)
    whole, levels, level, core = [], [at], 1, None
    while True:
        level += 1
        at = _cut(step(at, level))
        if at.isEmpty():
            break
        levels.append(at)
        if level == DEEP:
            core = _core(edges)
        if core is not None and not at.join(core.withColumnRenamed("id", node), node, "left_semi").isEmpty():
            raise ValueError(f"the hierarchy has a cycle, reached at level {level}")
        if len(levels) >= DEEP:
            whole.append(_cut(reduce(DataFrame.unionAll, levels)))
            levels = []
    return reduce(DataFrame.unionAll, [*whole, *levels])


def depths(nodes: DataFrame, child: str, parent: str) -> DataFrame:
    """(id, level): roots, whose parent is null, are level 1. A level is one join; the walk ends when a level is empty,
    however deep, and a cycle below a root is a ValueError."""
    at = nodes.where(F.col(parent).isNull()).select(F.col(child).alias("id"), F.lit(1).alias("level"))
    edges = _cut(nodes.where(F.col(parent).isNotNull()).select(F.col(child).alias("c"), F.col(parent).alias("p")))
    return _walk(at, edges, "id", lambda rows, level: rows.join(edges, F.col("id") == F.col("p")).select(F.col("c").alias("id"), F.lit(level).alias("level")))


def explode_bom(bom: DataFrame, roots: DataFrame, parent: str, child: str, qty: str) -> DataFrame:
    """(root, part, qty): everything below each root, with quantities multiplied down the levels and summed, however
    many levels there are. A cycle below a root is a ValueError."""
    edges = _cut(bom.select(F.col(parent).alias("p"), F.col(child).alias("c"), F.col(qty).cast("double").alias("q")))
    at = roots.select(F.col(roots.columns[0]).alias("root")).join(edges, F.col("root") == F.col("p")).select("root", F.col("c").alias("part"), F.col("q").alias("qty"))

    def step(rows: DataFrame, level: int) -> DataFrame:
        below = rows.join(edges, F.col("part") == F.col("p")).select("root", F.col("c").alias("part"), (F.col("qty") * F.col("q")).alias("qty"))
        return below.groupBy("root", "part").agg(F.sum("qty").alias("qty"))

    return _walk(at, edges, "part", step).groupBy("root", "part").agg(F.sum("qty").alias("qty"))


def _spread(rows: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows(id, colour)`` and all that ``step`` makes of what was new, the largest colour of each id, until nothing is new."""
    rows = new = rows.withColumn("fresh", F.lit(True))
    while True:
        reached = step(new).groupBy("id").agg(F.max("colour").alias("_colour"))
        both = rows.join(reached, "id", "full")
        fresh = F.col("_colour").isNotNull() & (F.col("colour").isNull() | (F.col("_colour") > F.col("colour")))
        rows = _cut(both.select("id", F.greatest("colour", "_colour").alias("colour"), fresh.alias("fresh")))
        new = rows.where("fresh")
        if new.isEmpty():
            return rows.drop("fresh")


def in_cycles(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(id): nodes on a cycle of any length, those with an edge to themselves included.

    Strongly connected groups by colours. Nodes without an edge in or out are peeled off. Then every node takes the
    largest id that leads to it, and a group is what leads back to the node of its colour inside the colour. Groups
    found are taken out, and the rest is coloured again. No pairs of nodes are made: a round is a join along edges."""
    left = _cut(edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(parent).alias("p"), F.col(child).alias("c")).distinct())
    found = [_cut(left.where("p = c").select(F.col("p").alias("id")))]
    left = left.where("p <> c")
    while (core := _core(left)) is not None:
        left = _cut(left.join(core.withColumnRenamed("id", "p"), "p", "left_semi").join(core.withColumnRenamed("id", "c"), "c", "left_semi"))
        nodes = _cut(core.select("id", F.col("id").alias("colour")))
        coloured = _spread(nodes, lambda new: new.join(left, F.col("id") == F.col("p")).select(F.col("c").alias("id"), "colour"))
        ends = coloured.withColumnRenamed("id", "p").withColumnRenamed("colour", "_colour")
        inside = _cut(left.join(ends, "p").join(coloured.withColumnRenamed("id", "c"), "c").where("colour = _colour").select("p", "c", F.col("colour").alias("_colour")))
        heads = _cut(coloured.where("id = colour"))
        groups = _spread(heads, lambda new: new.join(inside, (F.col("id") == F.col("c")) & (F.col("colour") == F.col("_colour"))).select(F.col("p").alias("id"), "colour"))
        large = groups.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("colour")
        found.append(groups.join(large, "colour", "left_semi").select("id"))
        left = _cut(left.join(groups.select(F.col("id").alias("p")), "p", "left_anti").join(groups.select(F.col("id").alias("c")), "c", "left_anti"))
    return reduce(DataFrame.unionAll, found).distinct()
