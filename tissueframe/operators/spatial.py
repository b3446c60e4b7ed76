"""Nearest-neighbour and distance joins of point tables by grid buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

XYZ = ("x", "y", "z")


def _cells(df: DataFrame, size: float, spread: bool) -> DataFrame:
    for a in XYZ:
        t = F.floor(F.col(a) / size)
        df = df.withColumn(f"_t{a}", F.explode(F.sequence(t - 1, t + 1)) if spread else t)
    return df


def _close(points: DataFrame, targets: DataFrame, size: float, by: list[str]) -> DataFrame:
    """Pairs at most ``size`` apart with ``dist``; every point meets the targets of its own and neighbouring buckets."""
    a = _cells(points, size, True)
    b = _cells(targets, size, False).select(*by, F.col("tid"), *[F.col(x).alias(f"_{x}") for x in XYZ], "_tx", "_ty", "_tz")
    dist = F.sqrt(sum((F.col(x) - F.col(f"_{x}")) * (F.col(x) - F.col(f"_{x}")) for x in XYZ))
    return a.join(b, [*by, "_tx", "_ty", "_tz"]).withColumn("dist", dist).filter(F.col("dist") <= size)


def within_distance(points: DataFrame, targets: DataFrame, distance: float, by: list[str] | None = None) -> DataFrame:
    """``points(pid, x, y, z)`` with ``near``: whether one of ``targets(tid, x, y, z)`` is at most ``distance`` away."""
    by = by or []
    hit = _close(points, targets, distance, by).select(*by, "pid").distinct().withColumn("near", F.lit(True))
    return points.join(hit, [*by, "pid"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def nearest_join(points: DataFrame, targets: DataFrame, size: float, by: list[str] | None = None, work: Workspace | None = None) -> DataFrame:
    """``pid, tid, dist`` of the nearest target of each point, the least ``tid`` on ties; exact.

    A point whose nearest target within the bucket size is found in the buckets around it is done, since nothing outside
    them is nearer. The rest go down an octree of the targets, whose nodes know the box of their targets: in each level
    a point keeps the nodes that may hold its nearest one, as told by the least of the greatest distances. Of the leaves
    that are left it visits the one with the least bound first, and then only those whose bound isn't above what it found.
    Points or targets with a null or NaN coordinate, and points without any target, don't occur.
    """
    by, work = by or [], work or Workspace(points.sparkSession)
    keys = [*by, "pid"]
    whole = " AND ".join(f"{a} IS NOT NULL AND NOT isnan(CAST({a} AS DOUBLE))" for a in XYZ)
    some = [F.col(x).cast("double").alias(x) for x in XYZ]
    targets, points = targets.filter(whole).select(*by, "tid", *some), points.filter(whole).select(*keys, *some)
    best = _close(points, targets, size, by).groupBy(*keys).agg(F.min(F.struct("dist", "tid")).alias("m"))
    found = work.write(best.select(*keys, "m.tid", "m.dist"))
    left = work.write(points.join(found, keys, "left_anti"))
    return found if left.isEmpty() else found.unionByName(_far(left, targets, size, by, work))


#: Targets in a leaf of the octree at most, unless they share the smallest bucket.
LEAF = 64


def octree(targets: DataFrame, size: float, by: list[str], work: Workspace) -> tuple[DataFrame, DataFrame, int]:
    """``nodes(by, level, ix, iy, iz, n, leaf, lo and hi of x, y, z)`` of all levels from buckets of ``size`` up to a single
    root, the targets with the ``level, ix, iy, iz`` of their leaf, and the root's level. A node of ``LEAF`` targets at most
    is a leaf, as is a bucket of any number."""
    # Buckets count from the least one, so that all of them meet in one root.
    first = targets.agg(*[F.min(F.floor(F.col(a) / size)).alias(a) for a in XYZ], *[F.max(F.floor(F.col(a) / size)).alias(f"{a}1") for a in XYZ]).first()
    height = max((int(first[f"{a}1"] - first[a]).bit_length() for a in XYZ if first[a] is not None), default=0)
    cell = targets.select("*", *[(F.floor(F.col(a) / size) - F.lit(first[a] or 0)).cast("long").alias(f"i{a}") for a in XYZ])
    box = [f(F.col(a)).alias(f"{n}{a}") for a in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    up = [f(F.col(f"{n}{a}")).alias(f"{n}{a}") for a in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    index = [f"i{a}" for a in XYZ]
    base = work.write(cell.groupBy(*by, *index).agg(F.count("*").alias("n"), *box))
    at = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(height)))).withColumns({i: F.expr(f"shiftright({i}, level)") for i in index})
    nodes = at.groupBy(*by, "level", *index).agg(F.sum("n").alias("n"), *up)
    nodes = work.write(nodes.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("level") == 0)))
    # A bucket's leaf is the highest node above it that is one.
    above = base.select(*by, *[F.col(i).alias(f"b{i}") for i in index], *index, F.explode(F.sequence(F.lit(0), F.lit(height))).alias("level")).withColumns({i: F.expr(f"shiftright({i}, level)") for i in index})
    above = above.join(nodes.filter("leaf").select(*by, "level", *index), [*by, "level", *index])
    top = above.groupBy(*by, *[f"b{i}" for i in index]).agg(F.max(F.struct("level", *index)).alias("t")).select(*by, *[F.col(f"b{i}").alias(i) for i in index], "t")
    leaves = cell.join(top, [*by, *index]).select(*by, "tid", *[F.col(a).alias(f"_{a}") for a in XYZ], "t.*")
    return nodes, work.write(leaves), height


def _far(points: DataFrame, targets: DataFrame, size: float, by: list[str], work: Workspace) -> DataFrame:
    """The nearest target of points that have none near, by the octree."""
    nodes, leaves, height = octree(targets, size, by, work)
    index, keys = [f"i{a}" for a in XYZ], [*by, "pid"]
    node = ["level", *index]
    # Bounds of the distance to a node's box, beyond rounding.
    low = F.sqrt(sum(F.pow(F.greatest(F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}"), F.lit(0.0)), F.lit(2)) for a in XYZ)) * (1 - 1e-12)
    high = F.sqrt(sum(F.pow(F.greatest(F.abs(F.col(f"lo{a}") - F.col(a)), F.abs(F.col(f"hi{a}") - F.col(a))), F.lit(2)) for a in XYZ)) * (1 + 1e-12)

    def kept(pairs: DataFrame) -> DataFrame:
        """Of each point the nodes whose least distance isn't above the least of the greatest ones."""
        told = work.write(pairs.select(*keys, *XYZ, *node, "leaf", low.alias("low"), high.alias("high")))
        least = told.groupBy(*keys).agg(F.min("high").alias("most"))
        return told.join(least, keys).filter("low <= most").drop("high", "most")

    root = nodes.filter(F.col("level") == height)
    held = kept(points.join(root, by) if by else points.crossJoin(F.broadcast(root)))
    for level in range(height, 0, -1):
        open_ = held.filter((F.col("level") == level) & ~F.col("leaf"))
        child = nodes.filter(F.col("level") == level - 1).select(*[F.col(c) for c in nodes.columns if c not in index], *[F.col(i).alias(f"c{i}") for i in index], *[F.expr(f"shiftright({i}, 1)").alias(i) for i in index]).drop("level", "leaf")
        leaf = nodes.filter(F.col("level") == level - 1).select(*by, *[F.col(i).alias(f"c{i}") for i in index], "leaf")
        down = open_.select(*keys, *XYZ, *index).join(child.join(leaf, [*by, *[f"c{i}" for i in index]]), [*by, *index]).drop(*index)
        down = down.withColumn("level", F.lit(level - 1)).withColumnsRenamed({f"c{i}": i for i in index})
        rest = held.filter((F.col("level") < level) | F.col("leaf")).join(nodes.drop("leaf", "n"), [*by, *node])
        held = kept(down.drop("n").unionByName(rest.drop("low")))
    held = work.write(held.select(*keys, *XYZ, *node, "low"))

    def met(pairs: DataFrame) -> DataFrame:
        """The nearest target of each point among those of leaves."""
        dist = F.sqrt(sum((F.col(x) - F.col(f"_{x}")) * (F.col(x) - F.col(f"_{x}")) for x in XYZ))
        return pairs.join(leaves, [*by, *node]).groupBy(*keys).agg(F.min(F.struct(dist.alias("dist"), "tid")).alias("m")).select(*keys, "m.tid", "m.dist")

    order = held.groupBy(*keys).agg(F.min(F.struct("low", *node)).alias("t"))
    begin = work.write(met(held.join(order, keys).filter(" AND ".join(f"{c} = t.{c}" for c in node)).drop("t")))
    more = held.join(order, keys).join(begin.select(*keys, "dist"), keys).filter("low <= dist AND NOT (" + " AND ".join(f"{c} = t.{c}" for c in node) + ")").drop("t", "dist")
    both = begin.unionByName(met(more))
    return both.groupBy(*keys).agg(F.min(F.struct("dist", "tid")).alias("m")).select(*keys, "m.tid", "m.dist")


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b)))
