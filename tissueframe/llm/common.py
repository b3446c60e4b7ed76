"""Shared parts of the text operators: Arrow batches, word hashes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
#: Texts are worked on in slices of about so many bytes, so that memory in a task does not follow the batch.
SLICE_BYTES = 1 << 18
#: Spark sends batches of about so many bytes at most to its Python workers (a single longer text is a batch of its own).
BATCH_BYTES = 4 << 20

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Batches], Batches], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose workers import this package from the driver's checkout, get batches bounded in bytes, and give
    Arrow's memory back at the end of a task."""
    env, conf = df.sparkSession.sparkContext.environment, df.sparkSession.conf
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Batches) -> Batches:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def whole_key(df: DataFrame, key: str) -> None:
    """Keys are carried as 64-bit whole numbers; any other type would merge rows, so it is an error."""
    kind = df.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{key} is {kind.simpleString()}; a key has to be a whole number")


def text_column(batch: pa.RecordBatch | pa.Table, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column and the int64 row offsets into them (one more than rows); null counts as empty."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, name: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of a batch holding about ``size`` text bytes each (one row at least), with bytes and offsets."""
    data, offs = text_column(batch, name)
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added as ``plus`` adds their fields."""
    new = {x.lower() for x in columns}
    names = [x for x in batch.schema.names if x.lower() not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *columns.values()], [*names, *columns])


def plus(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """The schema with fields added; one of the same name (in any case) is replaced."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + list(fields))


def binary_array(data: np.ndarray, offs: np.ndarray, large: bool = False) -> pa.Array:
    """Arrow binary from bytes and offsets without copying rows."""
    kind, width = (pa.large_binary(), np.int64) if large else (pa.binary(), np.int32)
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs.astype(width))), pa.py_buffer(np.ascontiguousarray(data))])


def list_array(values: np.ndarray, offs: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values))


# --- bit filters -----------------------------------------------------------------------------------

#: Bits of a filter at most; about ten for each key if they are fewer.
FILTER_BITS = 1 << 26


_SEEDS = (0x5BD1, 0x1B873593, 0xCC9E2D51)


def _place(keys: np.ndarray, seed: int, bits: int) -> np.ndarray:
    return mix(keys ^ np.uint64(seed)) & np.uint64(bits - 1)


def key_filter(df: DataFrame, key: str, count: int) -> np.ndarray:
    """A bit filter of the long column ``key``, ``count`` values: at most ``FILTER_BITS`` / 8 bytes reach the driver,
    whatever their number. It lets all of them through, and few others unless they are very many."""
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(12, (10 * count).bit_length()))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([_place(keys, s, bits) for s in _SEEDS])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "mask"])

    words = arrow_map(df.select(key), run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def held(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a filter lets through; further bits are asked only of those that the first lets through."""
    bits, out = len(filter_) << 6, np.zeros(len(keys), bool)
    some = np.arange(len(keys))
    for s in _SEEDS:
        at = _place(keys[some], s, bits)
        some = some[(filter_[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
    out[some] = True
    return out


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key isn't in ``gone``, a written table of distinct keys; those with a null key stay. A bit
    filter of one hash, sixteen bits a key but ``FILTER_BITS`` at most, is broadcast; only rows that it holds are joined,
    so the others aren't shuffled. ``df`` is read twice."""
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(12, (16 * gone.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    word, bit = F.floor(place / 64).cast("long"), (place % 64).cast("int")
    words = gone.select(word.alias("__word"), F.expr("1L").alias("__one"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(__one, __bit)")).alias("__mask"))
    placed = df.withColumns({"__at": word, "__bit": bit}).join(F.broadcast(words), F.col("__at") == F.col("__word"), "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(__mask, __bit) & 1 = 1"), F.lit(False))
    sure, maybe = (placed.filter(c).select(*[F.col(f"`{x}`") for x in df.columns]) for c in (~hit, hit))
    return sure.unionByName(maybe.join(gone, key, "left_anti").select(*[F.col(f"`{x}`") for x in df.columns]))


# --- words -----------------------------------------------------------------------------------------

#: A-Z lower-cased; words are runs of anything but space and 9-13.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse. Those for a slice are kept, longer ones made anew, so
    that one very long text doesn't stay in a worker's memory."""
    if n <= len(_KEPT[0]):
        return _KEPT[0], _KEPT[1]
    return _power(_BASE, n), _power(_INVERSE, n)


def _power(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_KEPT = _power(_BASE, SLICE_BYTES + 2), _power(_INVERSE, SLICE_BYTES + 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, runs of bytes not ``between`` words, and per row (one more) the index of its first."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~between[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    rows = offs[:-1][np.diff(offs) > 0]
    first[rows] = word[rows]
    rows = offs[1:][np.diff(offs) > 0] - 1
    last[rows] = word[rows]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, and per row (one more) the index of its first word."""
    starts, ends, rows = word_spans(data, offs, between)
    if not len(starts):
        return np.empty(0, np.uint64), rows
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each row, in order; a row with fewer words (but one at least) gives one
    shingle, its whole sequence. Also the row offsets."""
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    h = np.empty(out[-1], np.uint64)
    run = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        run = run * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
    run = mix(run)
    long = n >= k
    if long.any():
        at = np.repeat(rows[:-1][long] - np.concatenate([[0], np.cumsum(count[long])])[:-1], count[long]) + np.arange(count[long].sum())
        to = np.repeat(out[:-1][long] - np.concatenate([[0], np.cumsum(count[long])])[:-1], count[long]) + np.arange(count[long].sum())
        h[to] = run[at]
    for r in np.flatnonzero(~long & (n > 0)):
        x = np.uint64(n[r])
        with np.errstate(over="ignore"):
            for w in words[rows[r] : rows[r + 1]]:
                x = x * np.uint64(0xA0761D6478BD642F) + w
        h[out[r]] = mix(np.array([x], np.uint64))[0]
    return h, out
