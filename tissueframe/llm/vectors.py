"""Near-duplicate embeddings: an epsilon grid order join with exact counts of links, and components of the links.

Unit vectors whose cosine is c lie sqrt(2 - 2c) apart, so a join at a cosine is one at a distance, epsilon.

1. Copies of a vector collapse to one row with their number. Principal directions follow from the sums of products over
   all vectors; the leading ones span a grid of epsilon-wide cells.
2. Vectors are sorted by cells, in the order of directions; ``TILE_BYTES`` of them in a row are a tile, and ``FAN``
   consecutive tiles or nodes a node of the next level. Each knows its bounding box along the leading directions and a
   ball around its mean.
3. Pairs of sequence intervals are joined recursively, from the root: pairs of provably distant nodes go, pairs whose
   balls prove that all their vectors link are counted as a whole, and the others are split. What stays open between
   tiles is decided in a task that holds two tiles, by the same recursion down to blocks of ``LEAF`` vectors, whose
   cosines are a matrix product.

A task returns a count a vector and at most one link a vector that joins components, so a large group of near copies is
never spelled out as pairs; where it is tight, whole intervals count at once.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; nor do those
with a null key (its component is null, and it is kept), nor vectors of unlike lengths with each other. Rows that repeat
key and vector count once; rows that share only a key are vectors of their own. Other columns don't matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from ..workspace import Workspace
from .common import arrow_map, binary_array, whole_key

#: Leading directions that span the grid; bytes of vectors in a tile; nodes under one of the next level; vectors in a block.
LEAD, TILE_BYTES, FAN, LEAF = 16, 1 << 20, 8, 512
#: What a bound has to pass beyond rounding; cosines nearer to the limit than this are computed anew from the raw vectors.
SLACK = 1e-9
#: Vectors of unlike lengths lie at least so far apart along one more axis.
APART = 10.0


def _packed(df: DataFrame, key: str, vector: str, code: str) -> DataFrame:
    """``doc``, and the bytes and length of each vector that can link; others have null bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.cast(col.flatten(), pa.float64()).to_numpy(zero_copy_only=False).astype(code) + 0.0
            at = np.concatenate([[0], np.cumsum(lengths)])
            some = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            good = (some(~np.isfinite(values)) == 0) & (some(values != 0) > 0) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            raw = binary_array(values.view(np.uint8), at * values.itemsize)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pa.array(good), raw, pa.scalar(None, pa.binary())), pa.array(np.where(good, lengths, 0))], ["doc", "vec", "dim"])

    return arrow_map(df.select(F.col(key).cast("long").alias("doc"), F.col(vector).alias("vec")), run, "doc long, vec binary, dim long")


def _raw(column: pa.Array, width: int, code: str) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of doubles, filled with zeros to one width, and their lengths."""
    rows = [np.frombuffer(x, code) for x in column.to_pylist()]
    dims = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, dims


def _units(raw: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Unit vectors, with a last axis that keeps unlike lengths apart."""
    u = raw / np.abs(raw).max(1, keepdims=True)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    return np.hstack([u, (APART * dims)[:, None]])


def _products(reps: DataFrame, width: int, code: str) -> np.ndarray:
    """Principal directions as columns, the strongest first: sums of products over all vectors, summed up by Spark."""
    i, j = np.triu_indices(width + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            u = _units(*_raw(batch.column(0), width, code))
            u[:, -1] = 1
            total += u.T @ u
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    sums = arrow_map(reps.select("vec"), run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    full = np.zeros((width + 1, width + 1))
    full[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("s").to_numpy()
    full = np.triu(full) + np.triu(full, 1).T
    mean = full[:-1, -1] / max(full[-1, -1], 1)
    return np.linalg.eigh(full[:-1, :-1] / max(full[-1, -1], 1) - np.outer(mean, mean))[1][:, ::-1][:, :LEAD]


def _leads(u: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return np.hstack([u[:, -1:], u[:, :-1] @ basis])


def _bounds(u: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Box along the leading directions, and a ball."""
    centre = u.mean(0)
    d = u - centre
    return lead.min(0), lead.max(0), centre, float(np.sqrt((d * d).sum(1).max()))


class _Tile:
    """One side of a task: a sequence of vectors whose intervals have bounds, made when asked for."""

    def __init__(self, raw: np.ndarray, dims: np.ndarray, copies: np.ndarray, basis: np.ndarray) -> None:
        self.raw, self.dims, self.copies = raw, dims, copies
        self.u = _units(raw, dims)
        self.lead, self.made, self.links = _leads(self.u, basis), {}, np.zeros(len(raw), np.int64)

    def bounds(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        if (a, b) not in self.made:
            self.made[a, b] = _bounds(self.u[a:b], self.lead[a:b])
        return self.made[a, b]


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) that connect what the matrix connects, one less than nodes for each component."""
    out, row_left, col_left = [], near.any(1), near.any(0)
    while row_left.any():
        rows = np.array([int(row_left.argmax())])
        row_left[rows] = False
        while len(rows):
            cols = np.flatnonzero(near[rows].any(0) & col_left)
            col_left[cols] = False
            out += zip(rows[near[np.ix_(rows, cols)].argmax(0)].tolist(), cols.tolist())
            more = np.flatnonzero(near[:, cols].any(1) & row_left) if len(cols) else cols
            row_left[more] = False
            out += zip(more.tolist(), cols[near[np.ix_(more, cols)].argmax(1)].tolist()) if len(more) else ()
            rows = more
    return out


def _join(a: _Tile, b: _Tile, cosine: float) -> list[int]:
    """Adds the links between two tiles (or within one) to their counts; returns a root for each vector of a, then of b:
    vectors with one root are connected. Vectors of b are numbered after those of a, unless the tiles are one."""
    same, eps = a is b, math.sqrt(2 - 2 * cosine)
    shift = 0 if same else len(a.u)
    parent = list(range(shift + len(b.u)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def union(x: int, y: int) -> None:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)

    todo = [(0, len(a.u), 0, len(b.u))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        alone = same and a0 == b0
        lo, hi, ca, ra = a.bounds(a0, a1)
        lo2, hi2, cb, rb = b.bounds(b0, b1)
        gap = np.maximum(np.maximum(lo - hi2, lo2 - hi), 0)
        between = float(np.sqrt(((ca - cb) ** 2).sum()))
        if gap @ gap > (eps + SLACK) ** 2 or between - ra - rb > eps + SLACK:
            continue
        if between + ra + rb < eps - SLACK:
            total = int(b.copies[b0:b1].sum())
            a.links[a0:a1] += total - (a.copies[a0:a1] if alone else 0)
            if not alone:
                b.links[b0:b1] += a.copies[a0:a1].sum()
            for x in range(a0, a1):
                union(x, shift + b0)
            for y in range(b0, b1):
                union(a0, shift + y)
            continue
        if max(a1 - a0, b1 - b0) > LEAF:
            m, k = (a0 + a1) // 2, (b0 + b1) // 2
            if alone:
                todo += [(a0, m, a0, m), (a0, m, m, a1), (m, a1, m, a1)]
            elif a1 - a0 >= b1 - b0:
                todo += [(a0, m, b0, b1), (m, a1, b0, b1)]
            else:
                todo += [(a0, a1, b0, k), (a0, a1, k, b1)]
            continue
        x = a.u[a0:a1, :-1] @ b.u[b0:b1, :-1].T
        near = x >= cosine
        for i, j in zip(*np.nonzero(np.abs(x - cosine) < SLACK)):
            p, q = a.raw[a0 + i], b.raw[b0 + j]
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (p @ q) / (math.sqrt(p @ p) * math.sqrt(q @ q))
            if math.isfinite(exact):
                near[i, j] = exact >= cosine
        near &= a.dims[a0:a1, None] == b.dims[None, b0:b1]
        if alone:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        a.links[a0:a1] += near @ b.copies[b0:b1]
        if not alone:
            b.links[b0:b1] += near.T @ a.copies[a0:a1]
        for i, j in _spanning(near):
            union(a0 + i, shift + b0 + j)
    return [root(x) for x in range(len(parent))]


def _join_tiles(pairs: DataFrame, basis: np.ndarray, width: int, code: str, tile: int, cosine: float) -> DataFrame:
    """``rank, links, to``: for each vector of a pair of tiles that has links, their number and a vector that it is
    connected with."""

    def read(batch: pa.RecordBatch, row: int, side: str) -> _Tile:
        raw, dims = (np.frombuffer(batch.column(f"{c}_{side}")[row].as_buffer(), t) for c, t in (("vecs", code), ("dims", np.int32)))
        return _Tile(raw.reshape(-1, width).astype(np.float64), dims.astype(np.int64), np.frombuffer(batch.column(f"copies_{side}")[row].as_buffer(), np.int64), basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at, bt = (batch.column(c)[row].as_py() for c in ("a", "b"))
                a = read(batch, row, "a")
                b = a if at == bt else read(batch, row, "b")
                root = np.array(_join(a, b, cosine))
                links = a.links if a is b else np.concatenate([a.links, b.links])
                ranks = at * tile + np.arange(len(a.u))
                ranks = ranks if a is b else np.concatenate([ranks, bt * tile + np.arange(len(b.u))])
                has = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (ranks, links, ranks[root])], ["rank", "links", "to"])

    return arrow_map(pairs, run, "rank long, links long, to long")


def _tiles(placed: DataFrame, basis: np.ndarray, width: int, code: str) -> DataFrame:
    """A row for each tile: its vectors, numbers of copies and bounds."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank").combine_chunks()
        raw, dims = _raw(table.column("vec").combine_chunks(), width, code)
        copies, u = table.column("copies").to_numpy().astype(np.int64), _units(raw, dims)
        lo, hi, centre, radius = _bounds(u, _leads(u, basis))
        return pa.table({
            "node": [table.column("tile")[0].as_py()], "vecs": [raw.astype(code).tobytes()], "dims": [dims.astype(np.int32).tobytes()], "copies": [copies.tobytes()],
            "lo": [lo.tolist()], "hi": [hi.tolist()], "centre": [centre.tolist()], "radius": [radius], "size": [len(raw)], "weight": [int(copies.sum())],
        })

    return placed.select("tile", "rank", "vec", "copies").groupBy("tile").applyInArrow(pack, "node long, vecs binary, dims binary, copies binary, lo array<double>, hi array<double>, centre array<double>, radius double, size long, weight long")


STATS = ("lo", "hi", "centre", "radius", "size", "weight")


def _next_level(nodes: DataFrame) -> DataFrame:
    """Bounds of nodes of ``FAN`` nodes each."""
    fold = lambda c, f: F.expr(f"aggregate(k, k[0].{c}, (acc, x) -> zip_with(acc, x.{c}, (p, q) -> {f}(p, q)))")
    out = nodes.groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.collect_list(F.struct(*STATS)).alias("k"), F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    out = out.withColumn("centre", F.expr("transform(k[0].centre, (c, i) -> aggregate(k, 0D, (acc, x) -> acc + x.size * x.centre[i]) / size)"))
    radius = F.expr("array_max(transform(k, x -> x.radius + sqrt(aggregate(zip_with(x.centre, centre, (p, q) -> (p - q) * (p - q)), 0D, (acc, v) -> acc + v))))")
    return out.select("node", fold("lo", "least").alias("lo"), fold("hi", "greatest").alias("hi"), "centre", radius.alias("radius"), "size", "weight")


def _split(pairs: DataFrame, nodes: DataFrame, eps: float) -> DataFrame:
    """Pairs of the children of pairs that aren't provably distant, with whether all their vectors link."""
    side = lambda s: nodes.select(F.expr(f"node div {FAN}").alias(s), F.col("node").alias(f"{s}2"), F.struct(*STATS).alias(f"{s}s"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("a2 <= b2")
    total = "aggregate({}, 0D, (acc, v) -> acc + v)"
    gap = total.format("zip_with(zip_with(as.lo, bs.hi, (p, q) -> p - q), zip_with(bs.lo, as.hi, (p, q) -> p - q), (p, q) -> pow(greatest(p, q, 0D), 2))")
    between = f"sqrt({total.format('zip_with(as.centre, bs.centre, (p, q) -> (p - q) * (p - q))')})"
    told = both.selectExpr("a2 AS a", "b2 AS b", "as.weight AS wa", "bs.weight AS wb", "as.radius + bs.radius AS r", f"{gap} AS gap", f"{between} AS between")
    return told.filter(f"gap <= {(eps + SLACK) ** 2!r}D AND between - r <= {eps + SLACK!r}D").selectExpr("a", "b", "wa", "wb", f"between + r < {eps - SLACK!r}D AS whole")


def near_vectors(df: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, n_links, component_id, kept`` for every row: the number of other vectors with a cosine of ``cosine`` or more
    (0 < cosine < 1), the least key that such links lead to, and whether that is its own."""
    kind = df.schema[vector].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise TypeError(f"{vector} has to be an array of numbers")
    whole_key(df, key)
    spark, work = df.sparkSession, Workspace(df.sparkSession)
    code, eps = "<f4" if isinstance(kind.elementType, T.FloatType) else "<f8", math.sqrt(2 - 2 * cosine)
    rows = work.write(_packed(df, key, vector, code).withColumn("copy", F.md5("vec")))
    good = rows.filter("copy IS NOT NULL")
    number = good.select("copy", "doc").distinct().groupBy("copy").agg(F.count("*").alias("copies"), F.min("doc").alias("doc"))
    reps = work.write(good.groupBy("copy").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim")).join(number, "copy"))
    width, count = reps.agg(F.max("dim"), F.count("*")).first()
    single = F.when(F.col("doc").isNotNull(), F.col("doc"))
    if not count:
        return rows.select(F.col("doc").alias(key), F.lit(0).cast("long").alias("n_links"), single.alias("component_id"), F.lit(True).alias("kept"))
    basis = _products(reps, width, code)
    tile = max(2, TILE_BYTES // (np.dtype(code).itemsize * width))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = _leads(_units(*_raw(batch.column(1), width, code)), basis)
            grid = np.floor(lead / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(list(grid), pa.list_(pa.int32()))], ["copy", "vec", "copies", "doc", "cells"])

    gridded = arrow_map(reps.select("copy", "vec", "copies", "doc"), cells, "copy string, vec binary, copies long, doc long, cells array<int>")
    ordered = gridded.repartitionByRange("cells", "copy").sortWithinPartitions("cells", "copy").drop("cells").withColumn("at", F.monotonically_increasing_id())
    ordered = work.write(ordered).withColumns({"part": F.expr("shiftright(at, 33)"), "at": F.expr(f"at & {(1 << 33) - 1}")})
    parts = ordered.groupBy("part").agg(F.count("*").alias("c"))  # a row for each partition of the sort
    parts = parts.select("part", (F.sum("c").over(W.orderBy("part")) - F.col("c")).alias("before"))
    placed = ordered.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("at")).withColumn("tile", F.expr(f"rank div {tile}"))

    tiles = work.write(_tiles(placed, basis, width, code))
    levels, n = [tiles.select("node", *STATS)], -(-count // tile)
    while n > 1:
        levels.append(work.write(_next_level(levels[-1])))
        n = -(-n // FAN)
    open_, whole = spark.sql("SELECT 0L AS a, 0L AS b"), []
    for level in range(len(levels) - 2, -1, -1):
        told = work.write(_split(open_, levels[level], eps))
        open_ = told.filter("NOT whole").select("a", "b")
        whole.append(told.filter("whole").select(F.lit(level).alias("level"), "a", "b", "wa", "wb"))

    side = lambda s: tiles.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("vecs", "dims", "copies")])
    found = work.write(_join_tiles(open_.join(side("a"), "a").join(side("b"), "b"), basis, width, code, tile, cosine))
    counts, edges = found.select("rank", "links"), found.select(F.col("rank").alias("u"), F.col("to").alias("v"))
    if whole:
        pairs = whole[0]
        for w in whole[1:]:
            pairs = pairs.unionByName(w)
        more, joined = _whole(pairs, placed, tile, len(levels))
        counts, edges = counts.unionByName(more), edges.unionByName(joined)
    comp = components(edges.filter("u <> v"), work)
    total = counts.groupBy("rank").agg(F.sum("links").alias("links"))
    known = placed.select("rank", "copy", "copies", "doc").join(total, "rank", "left").join(comp.withColumnRenamed("node", "rank"), "rank", "left")
    known = work.write(known.select("copy", "doc", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rank").alias("component")))
    least = work.write(known.groupBy("component").agg(F.min("doc").alias("least")))
    named = work.write(known.join(least, "component").select("copy", "links", "least"))
    out = rows.select("doc", "copy").join(named, "copy", "left")
    own = F.coalesce("least", single)
    return out.select(F.col("doc").alias(key), F.coalesce("links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("doc"), F.lit(True)).alias("kept"))


def _whole(pairs: DataFrame, placed: DataFrame, tile: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Counts and links of pairs of nodes all of whose vectors link: a node's vectors get the sum of what its pairs add
    and are connected with its first one; the first ones of a pair are connected."""
    both = pairs.filter("a <> b")
    adds = both.select("level", F.col("a").alias("node"), F.col("wb").alias("add")).unionByName(both.select("level", F.col("b").alias("node"), F.col("wa").alias("add")))
    own = pairs.filter("a = b").select("level", F.col("a").alias("node"), F.col("wa").alias("add"), F.lit(1).alias("self"))
    marked = adds.withColumn("self", F.lit(0)).unionByName(own).groupBy("level", "node").agg(F.sum("add").alias("add"), F.max("self").alias("self"))
    span = lambda level: F.expr(f"cast(pow({FAN}, {level}) AS long) * {tile}")
    above = placed.select("rank", "copies", "tile", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    above = above.withColumn("node", F.expr(f"tile div cast(pow({FAN}, level) AS long)")).join(marked, ["level", "node"])
    heads = both.select((F.col("a") * span("level")).alias("u"), (F.col("b") * span("level")).alias("v"))
    members = above.select(F.col("rank").alias("u"), (F.col("node") * span("level")).alias("v"))
    return above.select("rank", (F.col("add") - F.col("self") * F.col("copies")).alias("links")), heads.unionByName(members)
