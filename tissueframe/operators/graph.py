"""Graph iteration over edge tables: connected components and bounded shortest paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace, dealt, dropped_shuffles, ship


def _written(work: Workspace, edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a written table, with their number and a hash, both observed during the write."""
    seen = Observation()
    out = work.write(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("x")))
    return out, (seen.get["n"], seen.get["x"])


def _large_star(edges: DataFrame, n: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Larger neighbours go to the least one of a node and its neighbours. That least node is a written table: so a hub
    is a skewed join of two plain exchanges, which adaptive execution splits; ``n`` edges decide whether they are."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = work.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(dealt(least, n), "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node itself, go to the least neighbour. Hubs are the lesser ends of their edges, so
    after the other star the join by the greater end has none."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``node, component``: the least node reachable over ``edges(u, v)``, by alternating large-star and small-star
    rounds, for every node of an edge with u <> v; no edges give no rows. Each round is a written table; a count and a
    hash of it come to the driver. Nodes may be of any type that has an order."""
    work = work or Workspace(edges.sparkSession)
    edges, before = _written(work, edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while before[0]:
        large, least = _large_star(edges, before[0], work)
        old, (edges, after) = edges, _written(work, _small_star(large))
        work.drop(old, least)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def running_total(df: DataFrame, by: list[str], order: list[str | Column], value: str | Column, name: str, work: Workspace | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of a value over the rows before each one in an order within its group, in two levels,
    so that no task holds a group: rows are sorted in ranges, and a range's rows of a group go on from the sums of the
    ranges before it."""
    work = work or Workspace(df.sparkSession)
    value = F.col(value) if isinstance(value, str) else value
    rows = df.withColumn("__v", value).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = work.write(rows.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy(*by, "__part").agg(F.sum("__v").alias("__c"))
    parts = parts.withColumn("__before", F.sum("__c").over(W.partitionBy(*by).orderBy("__part")) - F.col("__c")).drop("__c")
    within = F.sum("__v").over(W.partitionBy(*by, "__part").orderBy("__at")) - F.col("__v")
    return rows.withColumn("__within", within).join(parts, [*by, "__part"]).withColumn(name, F.col("__before") + F.col("__within")).select(*df.columns, name)


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str, work: Workspace | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in an order within each group, in two levels (``running_total``)."""
    return running_total(df, by, order, F.lit(1).cast("long"), name, work).withColumn(name, F.col(name) + 1)


#: So many edges, four numbers each, are walked by one task a group.
FEW_EDGES = 100_000


def greedy_matching(edges: DataFrame, by: list[str], work: Workspace | None = None, few: int = FEW_EDGES) -> DataFrame:
    """``by, a, b``: the pairs that a walk through the ``a`` of ``edges(by, a, b, weight)`` in rising order makes, each ``a``
    with the heaviest ``b`` (the lower, of equals) if both are in no pair yet. A node may be on either side; where both
    ends of an edge may ask, it has to be there in both directions.

    The walk runs in rounds: an ``a`` decides once no lower one that is left touches it or one of its ends. Rounds follow
    the longest row of rising neighbours, not the number of nodes; only edges between nodes that are left go on. Once no
    more than ``few`` edges are left in all, by count, the rest of each group is walked in one task, with the same pairs."""
    work = work or Workspace(edges.sparkSession)

    def counted(df: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        out = work.write(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return out, seen.get["n"]

    (left, n), done = counted(edges.select(*by, "a", "b", "weight")), None
    while n > few:
        touch = left.select(*by, "a", F.col("b").alias("node")).unionByName(left.select(*by, "a", F.col("a").alias("node")).distinct())
        low = touch.groupBy(*by, "node").agg(F.min("a").alias("low"))
        held = touch.join(dealt(low, n), [*by, "node"]).groupBy(*by, "a").agg(F.min("low").alias("low")).filter("low = a").select(*by, "a")
        best = left.join(dealt(held, n), [*by, "a"]).groupBy(*by, "a").agg(F.max(F.struct("weight", (-F.col("b")).alias("b"))).alias("t"))
        pairs = work.write(best.select(*by, "a", (-F.col("t.b")).alias("b")))
        taken = pairs.select(*by, F.explode(F.array("a", "b")).alias("node"))
        old, left = left, left
        for end in ("a", "b"):
            left = left.join(dealt(taken.withColumnRenamed("node", end), n), [*by, end], "left_anti")
        left, n = counted(left)
        work.drop(old)
        done = pairs if done is None else done.unionByName(pairs)
    walked = _walk(left, by)
    return walked if done is None else done.unionByName(walked)


def _walk(edges: DataFrame, by: list[str]) -> DataFrame:
    """``greedy_matching`` of groups that are known to be small."""

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        rows, taken, keep = group.sort_values(["a", "weight", "b"], ascending=[True, False, True]), set(), []
        for a, b in zip(rows["a"], rows["b"]):
            keep.append(free := a not in taken and b not in taken)
            if free:
                taken |= {a, b}
        return rows.loc[keep, [*by, "a", "b"]]

    ship(edges.sparkSession)
    return edges.groupBy(*by).applyInPandas(pairs, edges.select(*by, "a", "b").schema)


def bounded_paths(seeds: DataFrame, edges: DataFrame, radius: float, work: Workspace | None = None, step: float | None = None, symmetric: bool = False, laid: DataFrame | None = None) -> DataFrame:
    """``seed, node, dist`` of all nodes within ``radius`` of each seed along ``edges(src, dst, w)``, w >= 0, the seed
    included.

    Distances are settled in buckets of width ``step`` (without it, four mean weights), nearest first. Inside a bucket,
    rounds relax only what the last one made shorter, and compare it with the bucket's own rows; a settled bucket then
    sends what lies beyond it to the rows that wait. Where every edge has one back of the same weight (``symmetric``), a
    row reached from a bucket can only have been settled at most two greatest weights below it, so older buckets are
    never read again; rounds read and shuffle the frontier and its surroundings alone. Edges are laid out by ``src`` once
    (or given so, by ``laid_by_source``), so no round shuffles them, and each round gives its shuffle back at its end.
    """
    with dropped_shuffles(seeds.sparkSession):
        return _bounded_paths(seeds, edges, radius, work or Workspace(seeds.sparkSession), step, symmetric, laid)


def laid_by_source(edges: DataFrame, work: Workspace) -> DataFrame:
    """Edges as a written table for several searches."""
    return work.bucketed(edges.select("src", "dst", "w"), "src", int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bounded_paths(seeds: DataFrame, edges: DataFrame, radius: float, work: Workspace, step: float | None, symmetric: bool, laid: DataFrame | None) -> DataFrame:
    sizes = edges.agg(F.avg("w"), F.max("w")).first()
    mean, widest = (float(v or 0) for v in sizes)
    step = step or max(4 * mean, radius / 64, 1e-9)
    out_of = laid if laid is not None else laid_by_source(edges, work)
    least = lambda df: df.groupBy("seed", "node").agg(F.min("dist").alias("dist"))

    def shorter(found: DataFrame, known: list[DataFrame]) -> tuple[DataFrame, int]:
        """What is found at a lesser distance than known, as a written table, and its number."""
        if known:
            found = found.join(least(_all(known)).withColumnRenamed("dist", "__was"), ["seed", "node"], "left").filter("__was IS NULL OR dist < __was").drop("__was")
        seen = Observation()
        out = work.write(found.observe(seen, F.count(F.lit(1)).alias("n")))
        return out, seen.get["n"]

    def relaxed(rows: DataFrame) -> DataFrame:
        made = rows.join(out_of, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        return made.filter(F.col("dist") <= radius)

    waiting = work.write(seeds.select("seed", F.col("seed").alias("node"), F.lit(0.0).alias("dist")).distinct())
    settled: list[tuple[float, DataFrame]] = []
    done: list[DataFrame] = []
    while (nearest := waiting.agg(F.min("dist")).first()[0]) is not None:
        low = nearest // step * step
        high = low + step
        known = [t for upto, t in settled if not symmetric or upto >= low - 2 * widest - 1e-9]
        fresh, n = shorter(least(waiting.filter(F.col("dist") < high)), known)
        bucket = []
        while n:
            bucket.append(fresh)
            fresh, n = shorter(least(relaxed(fresh).filter(F.col("dist") < high)), [*known, *bucket])
        rest = waiting.filter(F.col("dist") >= high)
        old = waiting
        if bucket:
            own = work.write(least(_all(bucket))) if len(bucket) > 1 else bucket[0]
            settled.append((high, own))
            done.append(own)
            rest = rest.unionByName(relaxed(own).filter(F.col("dist") >= high))
            work.drop(*(b for b in bucket if b is not own))
        waiting = work.write(least(rest))
        work.drop(old)
    return _all(done) if done else waiting


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def paths_back(ends: DataFrame, before: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``seed, target, path``: for ``ends(seed, target)`` the nodes from the target back to the seed by ``before(seed, node,
    back)``, the node before each on its way (none for the seed itself).

    Jumps of 1, 2, 4, ... nodes are joined out of the ones half as long; only nodes that some path can pass are jumped
    from. Then each path's known nodes double from the longest jump down, so the rounds follow the logarithm of the
    longest path. ``path`` is gathered at the end, an array a path."""
    work = work or Workspace(ends.sparkSession)
    jumps = [work.write(before.select("seed", "node", "back"))]
    while True:
        far = jumps[-1].join(jumps[-1].select("seed", F.col("node").alias("back"), F.col("back").alias("__to")), ["seed", "back"]).select("seed", "node", F.col("__to").alias("back"))
        seen = Observation()
        far = work.write(far.observe(seen, F.count(F.lit(1)).alias("n")))
        if not seen.get["n"]:
            break
        jumps.append(far)
    at = work.write(ends.select("seed", "target", F.col("target").alias("node"), F.lit(0).cast("long").alias("place")))
    for k in range(len(jumps) - 1, -1, -1):
        more = at.join(jumps[k], ["seed", "node"]).select("seed", "target", F.col("back").alias("node"), (F.col("place") + (1 << k)).alias("place"))
        at = work.write(at.unionByName(more))
    path = F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda e: e["node"])
    return at.groupBy("seed", "target").agg(path.alias("path"))
