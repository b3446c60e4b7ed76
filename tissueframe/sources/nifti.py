"""The NIfTI-1 format: headers, samples and gzip streams, without Spark."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed values of the NIfTI-1 format: sample types by code.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
CODES = {v: k for k, v in TYPES.items()}
#: Bytes before the samples of a single-file image.
HEAD = 352


def nifti_head(shape: tuple[int, int, int], kind: str, spacing: tuple[float, float, float], origin: tuple[int, int, int] = (0, 0, 0)) -> bytes:
    """The 352 bytes before the samples of a single-file NIfTI-1 image; the affine scales by the spacing and moves the
    first voxel to ``origin``."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, CODES[kind], np.dtype(kind).itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    for row in range(3):
        struct.pack_into("<4f", head, 280 + 16 * row, *[spacing[row] if c == row else 0.0 for c in range(3)], spacing[row] * origin[row])
    head[344:348] = b"n+1\0"
    return bytes(head)


def nifti_bytes(volume: np.ndarray, spacing: tuple[float, float, float]) -> bytes:
    """A single-file NIfTI-1 image of an x, y, z array."""
    return nifti_head(volume.shape, volume.dtype.str[1:], spacing) + volume.astype(volume.dtype.newbyteorder("<")).tobytes(order="F")


def nifti_header(raw: bytes) -> dict:
    """Sizes, sample type, spacing rounded to six digits, scale and affine; ValueError for anything else."""
    if len(raw) < 348 or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
    dim = struct.unpack_from(order + "8h", raw, 40)
    code = struct.unpack_from(order + "h", raw, 70)[0]
    if code not in TYPES:
        raise ValueError(f"sample type {code} isn't supported")
    shape = tuple(max(1, d) for d in dim[1 : dim[0] + 1]) + (1,) * max(0, 4 - dim[0])
    slope, inter = struct.unpack_from(order + "2f", raw, 112)
    return {
        "shape": shape[:4], "dtype": np.dtype(order + TYPES[code]), "spacing": [round(x, 6) for x in struct.unpack_from(order + "8f", raw, 76)[1:4]], "offset": int(struct.unpack_from(order + "f", raw, 108)[0]),
        "slope": slope or 1.0, "inter": inter if slope else 0.0, "affine": [list(struct.unpack_from(order + "4f", raw, 280 + 16 * r)) for r in range(3)] + [[0.0, 0.0, 0.0, 1.0]],
        "origin": [round(struct.unpack_from(order + "f", raw, 292 + 16 * r)[0] / (struct.unpack_from(order + "f", raw, 80 + 4 * r)[0] or 1.0)) for r in range(3)],
    }


def unpacked(file: pa.NativeFile, size: int = 0, step: int = 4 << 20) -> Iterator[bytes]:
    """The bytes that gzip members in the next ``size`` bytes of a file (all, if 0) hold, piece by piece: packed bytes are
    read as they are needed."""
    left, tool = size or 1 << 62, zlib.decompressobj(31)
    data = b""
    while True:
        if not data:
            data = file.read(min(left, step))
            left -= len(data)
            if not data:
                return
        if tool.eof:
            tool = zlib.decompressobj(31)
        out = tool.decompress(data, step)
        data = tool.unused_data if tool.eof else tool.unconsumed_tail
        if out:
            yield out
