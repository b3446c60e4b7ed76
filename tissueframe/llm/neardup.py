"""MinHash near-duplicate groups: many universal-hash minima, banding, confirmation on full sets, components.

The steps, all linear in the rows but for blocks of groups that don't fall together at once:

1. A sketch of each text: size and digest of its shingle set, and band keys of its minima. Equal sets collapse to one
   representative by an aggregation, so exact copies never meet in a bucket.
2. Buckets of band keys; buckets with the same members count once. Each member is confirmed against its bucket's
   leader on the full sets (a star, not all pairs); components of the confirmed links. Full sets are made where the
   texts lie, for the members of buckets that a bit filter of bounded size lets through; texts aren't shuffled.
3. Where a bucket still holds several components, its members outside the largest one are compared with all others,
   in blocks of bounded size, first by signature, then, inside the groups that signatures leave, on the full sets.
   A block returns only links that join different components, so no pair of one group is spelled out.

What a group has in common (its leader, its largest component) is a written table before its members join it, so a hot
group is a skewed join of two plain exchanges, which adaptive execution splits.

Only the choice of hash functions is random: a pair at the threshold shares no band with a chance of ``MISS`` at most,
and one whose minima agree ``SIGMAS`` deviations too seldom isn't looked at in step 3.

Edge cases: null and empty texts, and texts without words, have empty sets, are linked with nothing and are their own
component; with fewer words than a shingle has, the whole sequence is the one shingle. Rows that share a key are one
document. A row with a null key is linked with nothing; its component is null and it is kept. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..workspace import Workspace
from .common import arrow_map, held, key_filter, list_array, mix, shingle_hashes, slices, whole_key, without, word_hashes

ROWS, MISS, SIGMAS = 6, 1e-6, 4.5
#: The weight of a block; two blocks meet in a task's memory at a time. A full set weighs 1 for each ``UNIT`` shingles
#: begun, so blocks are bounded in bytes as well as in members; of signatures, which are small, a block holds ``MANY``
#: times as many, so that fewer copies of each are dealt.
BLOCK, UNIT, MANY = 64, 1024, 4


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8_675_309)
    return rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each row in a row, and the rows' offsets."""
    h, at = shingle_hashes(*word_hashes(data, offs), k)
    sets = [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return (np.concatenate(sets) if sets else h), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def minima(values: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """For each non-empty set, the least value of each of ``n`` universal hash functions."""
    a, b = _coefficients(n)
    x = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out, y = np.empty((n, len(offs) - 1), np.uint32), np.empty_like(x)
    for j in range(n):
        np.multiply(x, a[j], out=y)
        np.add(y, b[j], out=y)
        np.minimum.reduceat(y, offs[:-1], out=out[j])
    return np.ascontiguousarray(out.T)


def _rows(column: pa.Array, rows: np.ndarray) -> pa.Array:
    return column.take(pa.array(rows))


def sketches(df: DataFrame, k: int, bands: int, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                values, at = shingle_sets(data, offs, k)
                full = np.flatnonzero(np.diff(at))
                keys = np.zeros((len(full), bands), np.uint64)
                if len(full):
                    least = minima(values, np.append(at[full], len(values)), bands * ROWS).reshape(len(full), bands, ROWS).astype(np.uint64)
                    keys += np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                    for r in range(ROWS):
                        keys = mix(keys ^ least[:, :, r])
                total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(s)))]) for s in (0x51ED, 0xA3C5F1)]
                count = np.zeros(part.num_rows, np.int64)
                count[full] = bands
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(np.diff(at)), *(pa.array((t[at[1:]] - t[at[:-1]]).view(np.int64)) for t in total), list_array(keys.ravel().view(np.int64), np.concatenate([[0], np.cumsum(count)]))],
                    ["doc", "n", "d1", "d2", "bands"],
                )

    return arrow_map(df.select(F.col(key).cast("long").alias(key), text), run, "doc long, n long, d1 long, d2 long, bands array<long>")


def full_sets(df: DataFrame, k: int, hashes: int, members: np.ndarray, key: str, text: str) -> DataFrame:
    """``doc, n, shingles`` and ``sig`` (the low byte of each minimum) of the texts whose key the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(key).is_valid())
            wanted = held(members, batch.column(key).to_numpy().view(np.uint64))
            for part, data, offs in slices(batch.filter(pa.array(wanted)), text):
                values, at = shingle_sets(data, offs, k)
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                sig = minima(values, np.append(at[full], len(values)), hashes).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [_rows(part.column(key), full), pa.array(np.diff(at)[full]), list_array(values.view(np.int64), np.append(at[full], len(values))), pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc", "n", "shingles", "sig"],
                )

    return arrow_map(df.select(F.col(key).cast("long").alias(key), text), run, "doc long, n long, shingles array<long>, sig binary")


def _similar(percent: int, a: str = "a", b: str = "b") -> str:
    return f"100 * {a} >= {percent} * ({b} - {a})"


def _blocks(members: DataFrame, work: Workspace, weight: int) -> DataFrame:
    """``members(g, doc, comp, w)``: of groups that hold several components, every row once for each pair of blocks in
    which it has to meet others. Blocks of the largest component don't meet each other; blocks have ``weight`` on
    average, and there are no more of them than rows."""
    by = members.groupBy("g", "comp").agg(F.sum("w").alias("c"), F.count("*").alias("r"))
    groups = by.groupBy("g").agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.sum("r").alias("rows"), F.max(F.struct("c", F.col("comp").alias("main"), "r")).alias("top"))
    groups = work.write(groups.filter("k > 1").select("g", "n", "rows", "top.main", "top.c", "top.r"))
    placed = members.join(groups, "g").selectExpr(
        "g", "doc", "comp", "comp = main AS main", f"n <= {weight} AS small",
        f"greatest(1, least(rows - r, int(ceil((n - c) / {weight})))) AS bl", f"greatest(1, least(r, int(ceil(c / {weight})))) AS bd",
    ).withColumn("own", F.expr("pmod(xxhash64(doc, 7), CASE WHEN main THEN bd ELSE bl END)").cast("int"))
    keys = F.expr(
        """CASE WHEN small THEN array(named_struct('p', 0, 'i', 0, 'j', 0))
        WHEN main THEN transform(sequence(0L, bl - 1), i -> named_struct('p', 1, 'i', int(i), 'j', own))
        ELSE concat(transform(sequence(0L, bl - 1), i -> named_struct('p', 2, 'i', int(least(i, own)), 'j', int(greatest(i, own)))),
                    transform(sequence(0L, bd - 1), j -> named_struct('p', 1, 'i', own, 'j', int(j)))) END"""
    )
    return placed.select("g", "doc", "comp", F.explode(keys).alias("at")).select("g", "doc", "comp", "at.*")


def _joins(near: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs marked in ``near``, those that join different components one after the other."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    found = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        a, b = root(int(comp[i])), root(int(comp[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((i, j))
    return found


def _by_signature(sig: np.ndarray, least: int) -> np.ndarray:
    near = np.zeros((len(sig), len(sig)), bool)
    for i in range(0, len(sig), 32):
        near[i : i + 32] = (sig[i : i + 32, None, :] == sig[None, :, :]).sum(2) >= least
    return np.triu(near, 1)


def _by_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs are similar: intersections as products of incidence matrices over slices of the shared shingles."""
    size = np.array([len(s) for s in sets], np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.flatnonzero(np.bincount(place, minlength=len(values)) > 1)
    rank = np.full(len(values), -1, np.int64)
    rank[shared] = np.arange(len(shared))
    at = rank[place]
    order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
    row, at = row[order], at[order]
    both, width = np.zeros((len(sets), len(sets)), np.int64), 4096
    for c in range(0, len(shared), width):
        lo, hi = np.searchsorted(at, [c, c + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[lo:hi], at[lo:hi] - c] = 1
        both += np.rint(m @ m.T).astype(np.int64)
    return np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)


def _in_groups(df: DataFrame, decide: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Links u, v from the groups (g, p, i, j) of rows doc, comp, ...; a group is as large as two blocks."""
    keys = ["g", "p", "i", "j"]

    def links(group: pa.Table) -> pa.RecordBatch:
        doc, comp = (group.column(c).to_numpy() for c in ("doc", "comp"))
        near = decide(group) & (comp[:, None] != comp[None, :])
        pairs = np.array(_joins(near, comp), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(doc[pairs[:, 0]]), pa.array(doc[pairs[:, 1]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in keys])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in keys):
                    yield links(pa.concat_tables(held).combine_chunks())
                    held = []
                held.append(part)
        if held:
            yield links(pa.concat_tables(held).combine_chunks())

    return arrow_map(df.repartition(*keys).sortWithinPartitions(*keys), run, "u long, v long")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row: the size of its set of ``words``-word shingles, the least
    key that links of Jaccard similarity ``percent`` / 100 or more lead to, and whether that is its own."""
    whole_key(df, key)
    work, bands = Workspace(df.sparkSession), bands_for(percent)
    hashes = bands * ROWS
    low = percent / 100 - SIGMAS * math.sqrt(percent / 100 * (1 - percent / 100) / hashes)

    sketch = work.write(sketches(df, words, bands, key, text))
    full = sketch.filter("n > 0 AND doc IS NOT NULL")
    sets = full.groupBy("d1", "d2", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    reps = work.write(sets)

    posting = reps.select("rep", F.explode("bands").alias("g"))
    buckets = posting.groupBy("g").agg(F.count("*").alias("c"), F.min("rep").alias("u"), F.expr("bit_xor(xxhash64(rep, 1))").alias("x"), F.expr("bit_xor(xxhash64(rep, 2))").alias("y"))
    buckets = work.write(buckets.filter("c > 1").groupBy("c", "x", "y").agg(F.min("g").alias("g"), F.min("u").alias("u")).select("g", "u"))
    members = work.write(posting.join(buckets, "g").select("g", F.col("rep").alias("doc"), "u"))

    wanted = work.write(members.select("doc").distinct())
    known = work.write(full_sets(df, words, hashes, key_filter(wanted, "doc", wanted.count()), key, text).join(wanted, "doc", "left_semi"))

    stars = members.filter("doc <> u").select(F.col("doc").alias("v"), "u").distinct()
    stars = stars.join(known.select(F.col("doc").alias("v"), F.col("shingles").alias("sv")), "v").join(known.select(F.col("doc").alias("u"), F.col("shingles").alias("su")), "u")
    stars = stars.select("u", "v", F.expr("size(array_intersect(su, sv))").alias("a"), F.expr("size(su) + size(sv)").alias("b"))
    links = work.write(stars.filter(_similar(percent)).select("u", "v"))
    comp = components(links, work)

    def with_comp(m: DataFrame, c: DataFrame) -> DataFrame:
        return m.join(c.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")

    least = math.ceil(low * hashes)
    open_ = _blocks(with_comp(members.select("g", "doc", F.lit(1).alias("w")), comp), work, MANY * BLOCK).join(known.select("doc", "sig"), "doc")

    def by_signature(group: pa.Table) -> np.ndarray:
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(group.num_rows, -1)
        return _by_signature(sig, least)

    maybe = work.write(_in_groups(open_, by_signature))
    if not maybe.isEmpty():
        loose = components(links.unionByName(maybe), work)
        group = loose.select(F.col("node").alias("doc"), F.col("component").alias("g")).join(known.select("doc", F.expr(f"n div {UNIT} + 1").alias("w")), "doc")
        blocks = _blocks(with_comp(group, comp), work, BLOCK).join(known.select("doc", "shingles"), "doc")

        def by_sets(g: pa.Table) -> np.ndarray:
            col = g.column("shingles").combine_chunks()
            col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
            values, at = col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
            return _by_sets([values[a:b] for a, b in zip(at[:-1], at[1:])], percent)

        more = work.write(_in_groups(blocks, by_sets))
        if not more.isEmpty():
            comp = components(links.unionByName(more), work)
    comp = work.write(comp)

    found = reps.select("d1", "d2", "n", "rep", "copies").join(comp.withColumnRenamed("node", "rep"), "rep", "left").filter("copies > 1 OR component IS NOT NULL")
    found = work.write(found.select("d1", "d2", "n", F.coalesce("component", "rep").alias("component")))
    work.drop(reps, buckets, members, wanted, known, links)
    out = sketch.select("doc", "n", "d1", "d2").join(found, ["d1", "d2", "n"], "left")
    own = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc") == own, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each group: that with the least key. Rows with a null key stay."""
    gone = near_duplicates(df, words, percent, key, text).filter("NOT kept").select(key).distinct()
    return without(df, Workspace(df.sparkSession).write(gone), key)
