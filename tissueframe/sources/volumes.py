"""NIfTI images as a Spark data source: files are cut into slabs of slices that tasks read side by side by byte ranges,
filters on x, y, z and path skip slabs and slices, and a writer commits slabs as files of their own.

A plain image is cut anywhere between slices. A gzip file is cut where this package wrote it, member by member: each
member's extra field tells its length and slices, so a plan hops from member to member and reads a few bytes of each.
A gzip file of another writer can't be cut; one task streams it, and stops after the last slice asked for.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..workspace import ship
from .nifti import HEAD, nifti_header, unpacked

#: Bytes of samples in a partition, about; rows in a batch.
PART_BYTES, ROWS = 32 << 20, 1 << 16
#: Fixed value: the extra field that tells a gzip member's length, first slice and number of slices.
EXTRA = struct.Struct("<2sH2sHQII")
FIXED = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"


def member(data: bytes, first: int, slices: int, level: int = 4) -> bytes:
    """A gzip member that names its own length and slices."""
    tool = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = tool.compress(data) + tool.flush()
    size = len(FIXED) + EXTRA.size - 2 + len(body) + 8
    extra = EXTRA.pack(b"", EXTRA.size - 4, b"TF", EXTRA.size - 8, size, first, slices)[2:]
    return FIXED + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _indexed(head: bytes) -> tuple[int, int, int] | None:
    """Length, first slice and number of slices of a member that names them."""
    if head[: len(FIXED)] != FIXED or head[12:14] != b"TF":
        return None
    return EXTRA.unpack(b"\0\0" + head[len(FIXED) : len(FIXED) + EXTRA.size - 2])[4:]


def files_of(path: str) -> list[str]:
    """Images under a path or glob, with the path's own scheme."""
    parts = path.split("/")
    cut = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
    base, pattern = "/".join(parts[:cut]), "/".join(parts[cut:])
    fs, root = pyarrow.fs.FileSystem.from_uri(base)
    if not pattern and fs.get_file_info(root).type == pyarrow.fs.FileType.File:
        return [path]
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = sorted(f.path[len(root) :].lstrip("/") for f in found if f.type == pyarrow.fs.FileType.File)
    deep = pattern.count("/")
    fits = lambda n: (n.count("/") == deep and fnmatch.fnmatchcase(n, pattern)) if pattern else n.endswith((".nii", ".nii.gz"))
    return [f"{base}/{n}" for n in names if fits(n) and not any(p[0] in "._" for p in n.split("/"))]


def reachable(path: str) -> bool:
    """Whether byte ranges can be read there without Spark."""
    try:
        pyarrow.fs.FileSystem.from_uri(path.split("*")[0].rsplit("/", 1)[0])
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False


def _open(path: str) -> pa.NativeFile:
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def header(path: str) -> dict:
    """The header of an image, from its first bytes."""
    with _open(path) as f:
        raw = f.read(4096)
    return nifti_header(zlib.decompressobj(31).decompress(raw, HEAD) if raw[:2] == b"\x1f\x8b" else raw)


@dataclass
class Slab:
    """Slices of a file: where their bytes begin, how many there are (all to the file's end, if 0), and whether they are
    plain, a member, or somewhere in a stream."""

    path: str
    kind: str
    at: int
    size: int
    first: int
    slices: int
    head: dict

    @property
    def bytes(self) -> int:
        return self.slices * self.head["shape"][0] * self.head["shape"][1] * self.head["dtype"].itemsize


def slabs_of(path: str, part_bytes: int) -> list[Slab]:
    h = header(path)
    nx, ny, nz, _ = h["shape"]
    flat = nx * ny * h["dtype"].itemsize
    with _open(path) as f:
        if f.read(2) != b"\x1f\x8b":
            d = max(1, part_bytes // flat)
            return [Slab(path, "plain", h["offset"] + k * flat, min(d, nz - k) * flat, k, min(d, nz - k), h) for k in range(0, nz, d)]
        at, out, end = 0, [], f.size()
        while at < end:
            f.seek(at)
            known = _indexed(f.read(len(FIXED) + EXTRA.size - 2))
            if known is None:
                return [Slab(path, "stream", 0, 0, 0, nz, h)]
            out.append(Slab(path, "member", at, known[0], known[1], known[2], h))
            at += known[0]
        return out


def slices_of(slab: Slab, wanted: range) -> Iterator[tuple[int, np.ndarray]]:
    """Number and samples of the wanted slices of a slab, one at a time."""
    h = slab.head
    nx, ny, nz, _ = h["shape"]
    flat = nx * ny * h["dtype"].itemsize
    ks = [k for k in range(slab.first, slab.first + slab.slices) if k in wanted]
    if not ks:
        return
    scaled = lambda raw: np.frombuffer(raw, h["dtype"]).astype(float) * h["slope"] + h["inter"]
    with _open(slab.path) as f:
        if slab.kind == "plain":
            for k in ks:
                f.seek(slab.at + (k - slab.first) * flat)
                raw = f.read(flat)
                if len(raw) < flat:
                    raise ValueError("the image is cut off")
                yield k, scaled(raw)
            return
        f.seek(slab.at)
        pieces, held, k = unpacked(f, slab.size), bytearray(), slab.first
        skip = h["offset"] if slab.first == 0 else 0
        while k <= ks[-1]:
            while len(held) < skip + flat:
                piece = next(pieces, b"")
                if not piece:
                    raise ValueError("the image is cut off")
                held.extend(piece)
            if k in wanted:
                yield k, scaled(bytes(held[skip : skip + flat]))
            del held[: skip + flat]
            skip, k = 0, k + 1


@dataclass
class Part(InputPartition):
    slabs: list[Slab] = field(default_factory=list)


class NiftiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.axes = options["path"], options.get("axes", "XYZ").lower()
        self.placed, self.part_bytes = options.get("placed", "false").lower() == "true", int(options.get("partbytes", PART_BYTES))
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}
        self.only: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds of x, y and z and one path are applied here, exactly; other filters are Spark's."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, IsNotNull) and name in ("path", "x", "y", "z"):
                continue
            if name == "path" and isinstance(f, EqualTo) and self.only is None:
                self.only = f.value
            elif name in ("x", "y", "z") and isinstance(getattr(f, "value", None), int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[name] = max(self.low.get(name, f.value), f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high[name] = min(self.high.get(name, f.value), f.value - isinstance(f, LessThan))
            else:
                yield f

    def _range(self, axis: str, size: int, origin: int) -> range:
        """The stored places along an axis that the filters leave."""
        lo, hi = self.low.get(axis, origin) - origin, self.high.get(axis, origin + size - 1) - origin
        return range(max(0, lo), min(size, hi + 1))

    def _origin(self, head: dict) -> list[int]:
        return head["origin"] if self.placed else [0, 0, 0]

    def partitions(self) -> list[Part]:
        """Slabs, those that the filters rule out left out; small ones share a partition."""
        names = [n for n in files_of(self.path) if self.only in (None, n)]
        with ThreadPoolExecutor(16) as pool:
            slabs = [s for found in pool.map(lambda n: slabs_of(n, self.part_bytes), names) for s in found]
        out: list[Part] = []
        room = 0
        for s in slabs:
            wanted = self._range(self.axes[2], s.head["shape"][2], self._origin(s.head)[2])
            if max(s.first, wanted.start) >= min(s.first + s.slices, wanted.stop):
                continue
            if not out or s.bytes > room:
                out.append(Part())
                room = self.part_bytes
            out[-1].slabs.append(s)
            room -= s.bytes
        return out or [Part()]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for slab in partition.slabs:
            shape, origin = slab.head["shape"], self._origin(slab.head)
            i, j = (np.arange(r.start, max(r.start, r.stop)) for r in (self._range(self.axes[a], shape[a], origin[a]) for a in range(2)))
            for k, data in slices_of(slab, self._range(self.axes[2], shape[2], origin[2])):
                data = data.reshape(shape[1], shape[0])[np.ix_(j, i)].ravel()
                for a in range(0, len(data), ROWS):
                    some = data[a : a + ROWS]
                    at = np.arange(a, a + len(some))
                    cols = {self.axes[0]: i[at % len(i)] + origin[0], self.axes[1]: j[at // len(i)] + origin[1], self.axes[2]: np.full(len(some), k + origin[2])}
                    yield pa.RecordBatch.from_arrays([pa.array([slab.path] * len(some)), *(pa.array(cols[x].astype(np.int64)) for x in "xyz"), pa.array(some)], ["path", "x", "y", "z", "intensity"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SlabWriter(DataSourceArrowWriter):
    """Rows ``name, content`` as files below the path: written under names of the attempt, and renamed by the commit; an
    attempt that fails leaves no file, and a repeated one replaces nothing but its own."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        attempt, done = TaskContext.get().taskAttemptId(), []
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                with fs.open_output_stream(part := f"{base}/.{name}-{attempt}", compression=None) as f:
                    f.write(content.as_buffer())
                done.append((part, f"{base}/{name}"))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        new = [f for m in messages if m for f in m.files]
        if self.overwrite:
            for f in fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)):
                if f.type == pyarrow.fs.FileType.File and f.path not in {part for part, _ in new}:
                    fs.delete_file(f.path)
        for part, name in new:
            fs.move(part, name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        for part, _ in (f for m in messages if m for f in m.files):
            if fs.get_file_info(part).type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(part)


class NiftiSource(DataSource):
    """``spark.read.format("nifti")`` with options ``axes``, ``placed`` and ``partBytes``."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return "path string, x long, y long, z long, intensity double"

    def reader(self, schema) -> NiftiReader:
        return NiftiReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> SlabWriter:
        return SlabWriter(dict(self.options), overwrite)


class HeaderReader(DataSourceReader):
    """Headers alone, ``FILES`` of them in a task."""

    FILES = 64

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        names = files_of(self.path)
        return [InputPartition(names[a : a + self.FILES]) for a in range(0, len(names), self.FILES)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name in partition.value:
            h = header(name)
            yield (name, *h["shape"][:3], *h["spacing"], h["affine"])


class HeaderSource(DataSource):
    """``spark.read.format("nifti_header")``."""

    @classmethod
    def name(cls) -> str:
        return "nifti_header"

    def schema(self) -> str:
        return "path string, x_size int, y_size int, z_size int, x_res double, y_res double, z_res double, affine array<array<double>>"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets filters reach them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (NiftiSource, HeaderSource):
        spark.dataSource.register(source)
