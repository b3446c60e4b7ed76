"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A document leaks an item of w words if one of its runs of exactly w words (or the whole document, if shorter) has a
weighted Jaccard similarity of ``percent`` / 100 or more with it: shingles of ``words`` words (all w, if fewer), each
weighted by how often it occurs. The steps:

1. Items are a table. Equal ones count once; each gets a SimHash of ``BITS`` bits, and those of its shingles that are
   rarest among items, so many that a window without any of them can't reach the similarity.
2. One pass over the documents, whatever the number of items: a bit filter of bounded size tells benchmark shingles, and
   stretches that windows rich enough in them cover are kept (an exact count bound). Equal stretches count once.
3. Stretches meet items that share a rare shingle, by an equi-join. Only pieces around the shared shingles go to the
   comparison, cut to under twice the item's size, so what is sent grows with the shared shingles whatever the stretch.
   Windows of the item's size that hold enough of its shingles are compared by fingerprints: any two within ``RADIUS``
   bits differ by ``PROBE`` bits at most in one of the blocks of 16 bits, so the others are left out by their blocks. At a similarity of 0.8 the expected distance is 39 of 256 bits with a deviation of 5.7, so 68 lies
   five deviations off, and those of unrelated windows (128, deviation 8) far beyond. That holds while all shingles are
   distinct: a repeated one outweighs the rest, so windows and items with a repeated shingle skip the fingerprints. The
   exact similarity decides.

Edge cases: null or empty documents and items never match; documents may be of any length; repeated documents or items
give a row each; a null key stays null; of equally similar windows the first is named. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace
from .common import arrow_map, held, key_filter, list_array, mix, slices, whole_key, without, word_hashes

BITS, RADIUS, BLOCK_BITS = 256, 68, 16
#: Two prints within the radius differ by so many bits at most in one of their blocks.
PROBE = RADIUS // (BITS // BLOCK_BITS)
#: Windows that are compared with an item at a time.
SLICE = 4096
#: Items, shingles of items, and stretches whose leaks, that a task writes: small tables don't become a file for each
#: partition of a shuffle, as each file starts processes beside the executor (on local disks, to set its mode).
TASK_ITEMS, TASK_SHINGLES, TASK_STRETCHES = 20_000, 1_000_000, 1_000


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each ``k`` words in a row."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
    return mix(out + np.uint64(k))


#: One for each 64 bits of a print.
SEEDS = (0x1234567, 0x89ABCDEF01, 0x5DEECE66D, 0xB5297A4D3F)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash prints, as blocks, of the windows of ``n`` shingles at ``starts``. Bits are summed between the ends of
    windows only, 64 of them at a time, so memory follows the shingles once and the windows, not their product."""
    ends = np.unique(np.concatenate([starts, starts + n]))
    at, to = np.searchsorted(ends, starts), np.searchsorted(ends, starts + n)
    out = np.empty((len(starts), BITS // 64, 8), np.uint8)
    for k, seed in enumerate(SEEDS):
        bits = np.unpackbits(mix(shingles[ends[0] : ends[-1]] ^ np.uint64(seed)).view(np.uint8).reshape(-1, 8), axis=1)
        total = np.zeros((len(ends), 64), np.int32)
        np.cumsum(np.add.reduceat(bits, ends[:-1] - ends[0], axis=0, dtype=np.int32), 0, out=total[1:])
        out[:, k] = np.packbits(2 * (total[to] - total[at]) > n, axis=1)
    return out.reshape(len(starts), BITS // 8).view(np.uint16)


def within(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which prints are at most ``RADIUS`` bits from ``one``: those near it in a block are counted in full."""
    far = np.bitwise_count(prints ^ one)
    near = np.flatnonzero((far <= PROBE).any(1))
    return near[far[near].sum(1, dtype=np.int64) <= RADIUS]


def repeating(shingles: np.ndarray, n: int) -> np.ndarray:
    """For each window of ``n`` shingles, whether it holds one of them twice."""
    order = np.argsort(shingles, kind="stable")
    twice = shingles[order[1:]] == shingles[order[:-1]]
    i, before = order[1:][twice], order[:-1][twice]
    i, before = i[i - before < n], before[i - before < n]
    size = len(shingles) + 1
    change = np.bincount(np.maximum(0, i - n + 1), minlength=size) - np.bincount(before + 1, minlength=size)
    return np.cumsum(change)[: len(shingles) - n + 1] > 0


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sums of the lesser and of the greater counts of the shingles of two windows."""
    values, count_a = np.unique(a, return_counts=True)
    other, count_b = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, other, assume_unique=True, return_indices=True)
    least = int(np.minimum(count_a[i], count_b[j]).sum())
    return least, len(a) + len(b) - least


def need(n: int, m: int, percent: int) -> int:
    """The shingles that windows of n and m shingles share at least, at the similarity asked for."""
    return -(-percent * (n + m) // (100 + percent))


def compare(own: np.ndarray, whole: bool, item: np.ndarray, mark: np.ndarray, repeats: bool, percent: int) -> tuple[int, int, float] | None:
    """Windows of a stretch that reach the similarity with an item, and the place and similarity of the best; ``whole``
    tells that the stretch is a whole document, which is one window if it is shorter than the item."""
    m = len(item)
    n = min(m, len(own)) if whole else m
    if n > len(own):
        return None
    total = np.concatenate([[0], np.cumsum(np.isin(own, item))])
    starts = np.flatnonzero(total[n:] - total[: len(total) - n] >= need(n, m, percent))
    if not len(starts):
        return None
    twice = repeating(own, n)[starts] | repeats
    some = [np.flatnonzero(twice)]
    plain = np.flatnonzero(~twice)
    # slices of windows end where the next one is not near, so that no slice spans what lies between far windows
    far = np.flatnonzero(np.diff(starts[plain]) > n) + 1
    for run in np.split(plain, far):
        for a in range(0, len(run), SLICE):
            part = run[a : a + SLICE]
            some.append(part[within(fingerprints(own, starts[part], n), mark)])
    starts = starts[np.concatenate(some)]
    # windows of the same shingles, in any order, are compared once
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own))])
    _, first, count = np.unique(total[starts + n] - total[starts], return_index=True, return_counts=True)
    windows, best = 0, None
    for f, c in zip(first.tolist(), count.tolist()):
        p = int(starts[f])
        both, either = similarity(own[p : p + n], item)
        if 100 * both >= percent * either:
            windows += c
            best = max(best or (0.0, 0), (both / either, -p))
    return best and (windows, -best[1], best[0])


def _items(benchmark: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """``item``, ``rep`` (the digest of its words, the same for equal items), ``k`` (words of a shingle), shingles in order,
    its print, and whether it repeats a shingle; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                h, at = word_hashes(data, offs)
                rows = np.flatnonzero(np.diff(at))
                own = [h[at[r] : at[r + 1]] for r in rows]
                ks = [min(words, len(w)) for w in own]
                shingles = [runs(w, k) for w, k in zip(own, ks)]
                offs_ = np.concatenate([[0], np.cumsum([len(s) for s in shingles], dtype=np.int64)])
                flat = np.concatenate(shingles) if shingles else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(pa.array(rows)), pa.array([_digest(w) for w in own], pa.binary()), pa.array(ks, pa.int32()), list_array(flat.view(np.int64), offs_),
                     pa.array([fingerprints(s, np.zeros(1, np.int64), len(s))[0].tobytes() for s in shingles], pa.binary()), pa.array([len(np.unique(s)) < len(s) for s in shingles], pa.bool_())],
                    ["item", "rep", "k", "shingles", "mark", "repeats"],
                )

    return arrow_map(benchmark.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), text), run, "item long, rep binary, k int, shingles array<long>, mark binary, repeats boolean")


def _digest(hashes: np.ndarray, kind: int = 0) -> bytes:
    """A 128-bit hash of a sequence of hashes and its kind."""
    seeds = np.array([2 * kind + 1, 2 * kind + 2], np.uint64) << np.uint64(40)
    return np.array([mix(hashes ^ mix(np.arange(len(hashes), dtype=np.uint64) + s)).sum(dtype=np.uint64) for s in seeds]).tobytes()


def _posting(items: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """``s, rep, k, m`` (the item's shingles): of each item the shingles that the fewest items hold, so many that the others
    together fall short of the least overlap. A shingle's rank among its item's counts those before it with repeats."""
    rows = items.select("rep", "k", F.size("shingles").alias("m"), F.explode("shingles").alias("s")).join(shingles, "s")
    order = W.partitionBy("rep").orderBy("often", "s")
    rows = rows.withColumns({"before": F.rank().over(order) - 1, "number": F.row_number().over(order) - 1})
    return rows.filter(f"before = number AND before <= m - ceil(m * {percent} / 100)").select("s", "rep", "k", "m")


def size_classes(sizes: list[int]) -> list[tuple[int, int]]:
    """Sorted sizes as ranges, least and largest, whose ends are at most an eighth apart."""
    out: list[tuple[int, int]] = []
    for m in sizes:
        if out and 8 * m <= 9 * out[-1][0]:
            out[-1] = (out[-1][0], m)
        else:
            out.append((m, m))
    return out


def _stretches(df: DataFrame, filter_: np.ndarray, sizes: list[tuple[int, int]], percent: int, key: str, text: str) -> DataFrame:
    """``row, key, k, whole, first, id, shingles``: the stretches of each document that windows rich enough in benchmark
    shingles cover, for items of ``sizes`` (words of a shingle, shingles). Equal stretches have the same ``id``."""
    by_k = {k: sorted({m for kk, m in sizes if kk == k}) for k in sorted({k for k, _ in sizes})}
    # A window shorter than its item holds percent / 100 of the item's shingles at least.
    least = {k: -(-percent * ms[0] // 100) for k, ms in by_k.items()}
    spans = {k: size_classes(ms) for k, ms in by_k.items()}

    def covered(hit: np.ndarray, classes: list[tuple[int, int]]) -> np.ndarray:
        """Shingles that lie in a rich window of one of the sizes, as change of the number of such windows. Sizes of a
        class count as the largest with what the least asks for, which covers all of them."""
        total, change = np.concatenate([[0], np.cumsum(hit)]), np.zeros(len(hit) + 1, np.int64)
        for lo, hi in classes:
            n, asked = min(hi, len(hit)), need(min(lo, len(hit)), lo, percent)
            if total[-1] < asked:
                break
            starts = np.flatnonzero(total[n:] - total[: len(total) - n] >= asked)
            if len(starts):
                np.add.at(change, starts, 1)
                np.add.at(change, starts + n, -1)
        return change

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, data, offs in slices(batch, text):
                h, at = word_hashes(data, offs)
                out: list[tuple] = []
                for k, classes in spans.items():
                    s = runs(h, k)
                    hit = held(filter_, s)
                    # shingles don't reach over a document's end
                    ends = at[1:-1, None] - np.arange(1, k)
                    hit[ends[(ends >= 0) & (ends < len(hit))]] = False
                    total = np.concatenate([[0], np.cumsum(hit)])
                    lo, hi = np.minimum(at[:-1], len(s)), np.maximum(np.minimum(at[:-1], len(s)), np.minimum(at[1:] - k + 1, len(s)))
                    for r in np.flatnonzero(total[hi] - total[lo] >= least[k]).tolist():
                        a, b = int(lo[r]), int(hi[r])
                        inside = np.cumsum(covered(hit[a:b], classes))[:-1] > 0
                        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
                        for x, y in edge.reshape(-1, 2).tolist():
                            own = s[a + x : a + y]
                            whole = y - x == b - a
                            out.append((row + r, part.column(key)[r].as_py(), k, whole, x, _digest(own, 2 * k + whole), own.view(np.int64)))
                row += part.num_rows
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["row", "key", "k", "whole", "first", "id", "shingles"])

    return arrow_map(df.select(F.col(key).cast("long").alias(key), text), run, "row long, key long, k int, whole boolean, first long, id binary, shingles array<long>")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """``id, rep, windows, place, similarity`` of the pairs of a stretch's piece and an item that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                own, item = (batch.column(c)[r].values.to_numpy().view(np.uint64) for c in ("own", "item"))
                mark = np.frombuffer(batch.column("mark")[r].as_py(), np.uint16)
                if found := compare(own, batch.column("whole")[r].as_py(), item, mark, batch.column("repeats")[r].as_py(), percent):
                    windows, place, best = found
                    out.append((batch.column("id")[r].as_py(), batch.column("rep")[r].as_py(), windows, batch.column("from")[r].as_py() + place, best))
            if out:
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["id", "rep", "windows", "place", "similarity"])

    return arrow_map(pairs, run, "id binary, rep binary, windows long, place long, similarity double")


def find_leaks(df: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item_key, windows, first_word, similarity``: a row for each document and item that it leaks, with the
    number of windows that reach the similarity and the best of them (the first, of equals)."""
    whole_key(df, key)
    whole_key(benchmark, item_key)
    spark, work = df.sparkSession, Workspace(df.sparkSession)
    every = work.write(_items(benchmark, words, item_key, item_text))
    items = every.drop("item").dropDuplicates(["rep"]).coalesce(1 + every.count() // TASK_ITEMS)
    items = work.write(items)
    sizes, total = items.agg(F.collect_set(F.struct("k", F.size("shingles"))), F.sum(F.size("shingles"))).first()
    if not sizes:
        return spark.createDataFrame([], f"`{key}` long, `{item_key}` long, windows long, first_word long, similarity double")
    tasks = 1 + total // TASK_SHINGLES
    shingles = items.select(F.explode(F.array_distinct("shingles")).alias("s")).groupBy("s").agg(F.count("*").alias("often"))
    shingles = work.write(shingles.coalesce(tasks))
    posting = work.write(_posting(items, shingles, percent).coalesce(tasks))
    stretches = work.write(_stretches(df, key_filter(shingles, "s", shingles.count()), [tuple(s) for s in sizes], percent, key, text))

    # both readers below take all of its columns, so that Spark groups the stretches once
    alike = stretches.groupBy("id").agg(F.first(F.struct("k", "whole", "shingles")).alias("a")).select("id", "a.k", "a.whole", F.col("a.shingles").alias("own"))
    # Windows that hold a shared shingle start in one of two tiles as wide as the item; a piece is a tile's windows.
    met = alike.select("id", "k", F.posexplode("own").alias("p", "s")).join(posting, ["s", "k"])
    tiles = met.select("id", "rep", "m", F.explode(F.array_distinct(F.array(F.expr("greatest(p - m + 1, 0) div m"), F.expr("p div m")))).alias("tile")).distinct()
    cut = tiles.join(alike.select("id", "whole", "own"), "id").filter("tile * m < size(own)")
    cut = cut.select("id", "rep", F.expr("whole AND size(own) <= m").alias("whole"), (F.col("tile") * F.col("m")).alias("from"), F.expr("slice(own, int(tile * m + 1), 2 * m - 1)").alias("own"))
    pairs = cut.join(items.select("rep", F.col("shingles").alias("item"), "mark", "repeats"), "rep")
    found = _verified(pairs, percent)

    hits = stretches.select("row", "key", "first", "id").join(found, "id")
    best = hits.groupBy("row", "key", "rep").agg(F.sum("windows").alias("windows"), F.min(F.struct((-F.col("similarity")).alias("s"), (F.col("first") + F.col("place")).alias("p"))).alias("b"))
    best = best.coalesce(1 + stretches.count() // TASK_STRETCHES)
    return best.join(every.select("rep", "item"), "rep").select(F.col("key").alias(key), F.col("item").alias(item_key), "windows", F.col("b.p").alias("first_word"), (-F.col("b.s")).alias("similarity"))


def drop_leaks(df: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that leak no item; those with a null key stay."""
    gone = find_leaks(df, benchmark, words, percent, key, text).select(key).filter(F.col(key).isNotNull()).distinct()
    return without(df, Workspace(df.sparkSession).write(gone), key)
