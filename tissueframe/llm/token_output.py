"""Token ids in training order: fixed-stride binary shards, filled in the order of a keyed permutation.

Texts are encoded and cut into sequences of ``length`` ids, the last of a text filled up with the end mark, the first id
that the vocabulary leaves free. The sequences are a written table; they are numbered by its partitions and their places
in these, and a Feistel network over the next even power of two, walked until it falls below their number, gives each a
slot of its own: a permutation that needs no sort of random keys and no memory. Ranges of slots are shards; records
travel to the task of their range in compressed groups; the task puts the bounded range in order and writes each shard as
one file of equal records, to a temporary name first, so a repeated task does no harm. The ranges are dealt to a few
passes over the table, and what a pass has shuffled is given back at its end, so that a part of the records at most lies
on disk a third time, beside the table and the shards.

``manifest.json`` beside the shards holds the parameters, a digest of the input, and the numbering; the numbered table
stands below ``sequences`` until all shards are written. A run on the same folder goes on from there, whatever the
partitioning of its input, and leaves shards that are whole; one with other parameters or other input, or that finds
shards without a manifest, is refused.

A record is 16 + ``width`` ``length`` bytes, little-endian: key (8), sequence number within the text (4; -1 - number where
the key is null), ids that aren't filling (4), ids (``width`` each: 2 bytes, or 4 for a vocabulary of 2^16 ids or more).
Record k of shard s is slot s * ``per_shard`` + k.

Edge cases: null and empty texts give one sequence that holds only the end mark; no rows give no shards; texts of any
length are cut whole; repeated rows give sequences of their own. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import delete, dropped_shuffles, shared_dir
from .bpe import class_runs, codec
from .common import arrow_map, binary_array, mix, slices, text_column, whole_key

LENGTH, PER_SHARD, ROUNDS = 256, 4096, 6
#: Shards that a task writes have so many bytes together; it holds them to put them in order. As many bytes of records
#: are grouped at once before they are sent, so that groups stay large where there are many ranges.
PART_BYTES = 32 << 20
#: Passes over the table of sequences; each shuffles its share of the records.
PASSES = 2
#: Ids compress well: how the encoded sequences are kept until their shards are written, and sent, which is for less long.
LEVEL, SENT_LEVEL = 6, 3
SQUEEZED = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(LEVEL), "parquet.page.size": str(8 << 20)}


def feistel(index: np.ndarray, count: int, key: int) -> np.ndarray:
    """A permutation of 0 ... count - 1, chosen by the key."""
    half = max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F + 1) % (1 << 64)) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (high := np.flatnonzero(out >= count)).size:
        out[high] = once(out[high])
    return out.astype(np.int64)


def end_and_width(ranks: str) -> tuple[int, int]:
    """The end mark of a vocabulary, its first free id, and the bytes of an id."""
    end = len(codec(ranks).size)
    return end, 2 if end < 1 << 16 else 4


def sequences(df: DataFrame, ranks: str, length: int, key: str, text: str) -> DataFrame:
    """``part, place, record`` for each sequence: the partition it comes from, its place in it, and its record without
    filling."""
    end, width = end_and_width(ranks)
    runs = class_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, place, partition = codec(ranks, runs), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part, _, _ in slices(batch, text):
                ids, at = c.encode([x or "" for x in part.column(text).to_pylist()])
                n = np.diff(at) + 1
                rows = -(-n // length)
                first = np.cumsum(rows) - rows
                body = np.full((int(rows.sum()), length), end, f"<u{width}")
                body.ravel()[np.repeat(first * length - at[:-1], n - 1) + np.arange(len(ids))] = ids
                head = np.zeros(len(body), [("key", "<i8"), ("number", "<i4"), ("used", "<i4")])
                column = part.column(key)
                head["key"] = np.repeat(column.fill_null(0).to_numpy(), rows)
                number = np.arange(len(body)) - np.repeat(first, rows)
                head["used"] = np.minimum(length, np.repeat(n, rows) - number * length)
                head["number"] = np.where(np.repeat(column.is_null().to_numpy(zero_copy_only=False), rows), -1 - number, number)
                records = np.hstack([head.view(np.uint8).reshape(len(body), 16), body.view(np.uint8)])
                size = 16 + width * head["used"].astype(np.int64)
                records = records[np.arange(records.shape[1]) < size[:, None]]
                where = np.arange(place, place + len(body))
                place += len(body)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(body), partition)), pa.array(where), binary_array(records, np.concatenate([[0], np.cumsum(size)]))], ["part", "place", "record"])

    return arrow_map(df.select(F.col(key).cast("long").alias(key), text), run, "part long, place long, record binary")


def filled(raw: np.ndarray, offs: np.ndarray, order: np.ndarray, length: int, end: int, width: int) -> bytes:
    """The records named by ``order`` in a row, each filled up to the full stride."""
    n, stride, size = len(order), 16 + width * length, (offs[1:] - offs[:-1])[order]
    out = np.tile(np.concatenate([np.zeros(16, np.uint8), np.frombuffer(end.to_bytes(width, "little") * length, np.uint8)]), n)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(n) * stride, size) + inside] = raw[np.repeat(offs[:-1][order], size) + inside]
    return out.tobytes()


def _file(path: str, name: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, base = pyarrow.fs.FileSystem.from_uri(path)
    return fs, f"{base}/{name}"


def manifest(path: str) -> dict | None:
    fs, name = _file(path, "manifest.json")
    if fs.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
        return None
    with fs.open_input_stream(name) as f:
        return json.loads(f.read())


def _put_manifest(path: str, what: dict) -> None:
    fs, name = _file(path, "manifest.json")
    with fs.open_output_stream(f"{name}.new") as f:
        f.write(json.dumps(what).encode())
    fs.move(f"{name}.new", name)


def _has_shards(path: str) -> bool:
    fs, base = pyarrow.fs.FileSystem.from_uri(path)
    return any(f.base_name.startswith("shard-") for f in fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)))


def _identity(df: DataFrame, ranks: str, length: int, per_shard: int, seed: int, key: str, text: str) -> dict:
    """What a folder's shards follow from: the parameters, and a digest of the rows in any order."""
    with open(ranks, "rb") as f:
        vocabulary = hashlib.sha256(f.read()).hexdigest()
    k, t = F.col(key).cast("long"), F.col(text)
    row = df.agg(F.count("*").alias("n"), *[F.coalesce(F.bit_xor(F.xxhash64(k, t, k.isNull(), t.isNull(), F.lit(s))), F.lit(0)).alias(f"x{s}") for s in (1, 2)], F.coalesce(F.sum(F.xxhash64(k, t) % 1_000_003), F.lit(0)).alias("s")).first()
    return {"length": length, "per_shard": per_shard, "seed": seed, "vocabulary": vocabulary, "rows": row["n"], "digest": [row["x1"], row["x2"], row["s"]]}


def write_shards(df: DataFrame, ranks: str, path: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, seed: int = 1, key: str = "doc_id", text: str = "text") -> str:
    """Writes all shards below ``path`` (a folder that all executors reach; by default a new one in the shared folder) and
    returns it. On a folder with a run of the same parameters and input it writes what is missing; ValueError for any
    other folder with shards."""
    whole_key(df, key)
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    end, width = end_and_width(ranks)
    identity, known, table = _identity(df, ranks, length, per_shard, seed, key, text), manifest(path), f"{path}/sequences"
    if known is None:
        if _has_shards(path):
            raise ValueError(f"{path} holds shards without a manifest")
        sequences(df, ranks, length, key, text).write.mode("overwrite").options(**SQUEEZED).parquet(table)
        counts = sorted((r["part"], r["n"]) for r in spark.read.parquet(table).groupBy("part").agg(F.count("*").alias("n")).collect())
        known = {"identity": identity, "width": width, "end": end, "parts": [p for p, _ in counts], "counts": [n for _, n in counts], "done": False}
        _put_manifest(path, known)
    if known["identity"] != identity:
        raise ValueError(f"{path} holds shards of other parameters or other input")
    total = sum(known["counts"])
    if known["done"] or not total:
        return path
    rows = spark.read.parquet(table)
    parts_, starts = np.array(known["parts"], np.int64), np.cumsum([0, *known["counts"]])[:-1]
    stride, shards = 16 + width * length, -(-total // per_shard)

    parts = min(shards, max(1, -(-total * stride // PART_BYTES)))

    def placed(low: int, high: int) -> DataFrame:
        """The records of the ranges from ``low`` to below ``high``, in groups, each with the others of its range."""

        def grouped(slot: list[np.ndarray], to: list[np.ndarray], record: list[pa.Array]) -> pa.RecordBatch:
            pack, order = zstandard.ZstdCompressor(level=SENT_LEVEL).compress, np.argsort(np.concatenate(to), kind="stable")
            raw, offs = text_column(pa.RecordBatch.from_arrays([pa.concat_arrays(record).take(pa.array(order))], ["record"]), "record")
            size, slot, to = np.diff(offs), np.concatenate(slot)[order], np.concatenate(to)[order]
            cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            blobs = [pack(np.int64(b - a).tobytes() + slot[a:b].tobytes() + size[a:b].tobytes() + raw[offs[a] : offs[b]].tobytes()) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array((to[cuts[:-1]] - low).astype(np.int32)), pa.array(blobs, pa.binary())], ["to", "blob"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, held = [], 0
            for batch in batches:
                base = starts[np.searchsorted(parts_, batch.column("part").to_numpy())]
                slot = feistel(base + batch.column("place").to_numpy(), total, seed)
                to = slot // per_shard * parts // shards
                own = np.flatnonzero((to >= low) & (to < high))
                if len(own):
                    waiting.append((slot[own], to[own], batch.column("record").take(pa.array(own))))
                    held += waiting[-1][2].nbytes
                if held >= PART_BYTES:
                    yield grouped(*zip(*waiting))
                    waiting, held = [], 0
            if waiting:
                yield grouped(*zip(*waiting))

        return arrow_map(rows, run, "to int, blob binary").repartitionById(high - low, "to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, size, raw = [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                data = unpack(blob)
                n = int(np.frombuffer(data, np.int64, 1)[0])
                slot.append(np.frombuffer(data, np.int64, n, 8))
                size.append(np.frombuffer(data, np.int64, n, 8 + 8 * n))
                raw.append(np.frombuffer(data, np.uint8, -1, 8 + 16 * n))
        if not slot:
            return
        slot, size, raw = np.concatenate(slot), np.concatenate(size), np.concatenate(raw)
        offs, order = np.concatenate([[0], np.cumsum(size)]), np.argsort(slot)
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        attempt, shard = TaskContext.get().taskAttemptId(), slot[order] // per_shard
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            name, whole = f"{base}/shard-{shard[a]:08d}.bin", (b - a) * stride
            if fs.get_file_info(name).size != whole:
                part = f"{base}/.shard-{shard[a]:08d}-{attempt}"
                with fs.open_output_stream(part) as f:
                    f.write(filled(raw, offs, order[a:b], length, end, width))
                fs.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])]), pa.array([whole])], ["shard", "bytes"])

    ends, written = np.unique(np.arange(PASSES + 1) * parts // PASSES).tolist(), []
    for low, high in zip(ends, ends[1:]):
        with dropped_shuffles(spark):
            written.append(arrow_map(placed(low, high), write, "shard long, bytes long").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first())
    files, size = (sum(r[x] for r in written) for x in ("n", "b"))
    if (files, size) != (shards, total * stride):
        raise RuntimeError(f"{files} shards of {size} bytes were written, not {shards} of {total * stride}")
    _put_manifest(path, known | {"done": True})
    delete(spark, table)
    return path


def read_shards(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """``slot, shard, key, number, used, ids`` (binary, little-endian) from ``first_slot`` on; whole shards before it
    aren't opened. ValueError for a folder without a finished run."""
    known = manifest(path)
    if not known or not known["done"] and known["counts"]:
        raise ValueError(f"{path} holds no finished run")
    per_shard, ids = known["identity"]["per_shard"], known["width"] * known["identity"]["length"]
    kind = np.dtype([("key", "<i8"), ("number", "<i4"), ("used", "<i4"), ("ids", f"S{ids}")])
    schema = "slot long, shard long, key long, number int, used int, ids binary"
    if not known["counts"]:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist()):
                rows = np.frombuffer(content, kind)
                raw = np.frombuffer(content, np.uint8).reshape(len(rows), kind.itemsize)[:, 16:]
                slot, number = shard * per_shard + np.arange(len(rows)), rows["number"].astype(np.int32)
                out = pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(np.full(len(rows), shard)), pa.array(rows["key"].astype(np.int64), mask=number < 0), pa.array(np.where(number < 0, -1 - number, number).astype(np.int32)),
                     pa.array(rows["used"].astype(np.int32)), binary_array(np.ascontiguousarray(raw).ravel(), np.arange(len(rows) + 1) * ids)],
                    ["slot", "shard", "key", "number", "used", "ids"],
                )
                yield out.slice(max(0, first_slot - int(slot[0])))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path)
    files = files.select(F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long").alias("shard"), "content")
    return arrow_map(files.filter(F.col("shard") >= first_slot // per_shard), run, schema)
