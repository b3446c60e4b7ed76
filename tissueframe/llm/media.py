"""Media columns: payloads as PNG images in binary columns, read back and hashed by their low frequencies.

A payload becomes the rows of an 8-bit RGB image of ``WIDTH`` pixels. Each row is filtered by the least sum of
absolute differences (none, left or upper pixel), all rows go through zlib, and each chunk carries its checksum. Reading
tests signature, lengths and checksums and undoes all five filters of the format. The feature is the sign pattern of the
64 lowest cosine-transform coefficients of the grey picture shrunk to 32 x 32.

Edge cases: null counts as empty and gives one row of blanks; texts of any length are taken whole; what isn't a whole,
sound picture reads as null with ``sound`` false. Equal texts give equal media and features. Other columns pass through,
and columns named like the outputs are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append, arrow_map, plus, slices

WIDTH, CHANNELS, LEVEL = 64, 3, 5
STRIDE = WIDTH * CHANNELS
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 20


def padded(raw: bytes) -> bytes:
    """Blanks appended up to a positive multiple of a row."""
    return raw.ljust(max(1, -(-len(raw) // STRIDE)) * STRIDE, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(rows: np.ndarray) -> np.ndarray:
    """Each row after its filter's number."""
    left, upper = rows.copy(), rows.copy()
    left[:, CHANNELS:] -= rows[:, :-CHANNELS]
    upper[1:] -= rows[:-1]
    forms = (rows, left, upper)
    cost = np.stack([np.minimum(f, np.uint8(0) - f).sum(1, dtype=np.int64) for f in forms])
    pick = cost.argmin(0)
    out = np.empty((len(rows), 1 + STRIDE), np.uint8)
    out[:, 0] = pick
    for k, f in enumerate(forms):
        out[pick == k, 1:] = f[pick == k]
    return out


def write_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, STRIDE)
    body = zlib.compress(_filtered(rows).tobytes(), LEVEL)
    parts = [_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered rows. Without the two filters that mix left and upper pixels, sums along and down the rows
    restore all rows at once."""
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    if (kinds < 3).all():
        out = rows.copy()
        sub = kinds == 1
        out[sub] = np.add.accumulate(rows[sub].reshape(-1, rows.shape[1] // step, step), 1, dtype=np.uint8).reshape(-1, rows.shape[1])
        up = kinds == 2
        if up.any():
            total = np.add.accumulate(out, 0, dtype=np.uint8)
            base = np.maximum.accumulate(np.where(up, -1, np.arange(len(rows))))
            value = np.where((base >= 0)[:, None], out[base] - total[base], np.uint8(0))
            out[up] = (total + value)[up]
        return out
    out, above = np.empty_like(rows), np.zeros(rows.shape[1], np.uint8)
    for r, kind in enumerate(kinds.tolist()):
        row = rows[r]
        if kind == 0:
            now = row.copy()
        elif kind == 1:
            now = np.add.accumulate(row.reshape(-1, step), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = row + above
        else:
            now = np.zeros(rows.shape[1], np.uint8)
            left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
            for i in range(0, rows.shape[1], step):
                top = above[i : i + step].astype(np.int64)
                if kind == 3:
                    guess = (left + top) // 2
                else:
                    d = np.stack([abs(top - corner), abs(left - corner), abs(left + top - 2 * corner)])
                    guess = np.choose(d.argmin(0), [left, top, corner])
                now[i : i + step] = (row[i : i + step] + guess) & 255
                left, corner = now[i : i + step].astype(np.int64), top
        out[r] = above = now
    return out


def read_png(data: bytes) -> np.ndarray:
    """Rows x columns x channels; ValueError for what isn't a whole 8-bit grey, RGB or RGBA picture without interlace."""
    if data[:8] != SIGNATURE:
        raise ValueError("signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or zlib.crc32(kind + part) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended, at = kind == b"IEND", at + 12 + n
    if not head or not ended or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("kind of picture")
    channels = {0: 1, 2: 3, 6: 4}[head[3]]
    width = head[0] * channels
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), head[1] * (1 + width) + 1)
    except zlib.error as e:
        raise ValueError("stream") from e
    if len(raw) != head[1] * (1 + width):
        raise ValueError("size")
    rows = np.frombuffer(raw, np.uint8).reshape(head[1], 1 + width)
    return unfilter(rows[:, 0], rows[:, 1:], channels).reshape(head[1], head[0], channels)


def _cosines(n: int, keep: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(keep)[:, None])


_DCT = _cosines(32, 8)


def low_frequency_hash(picture: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest coefficients lie above their median (the constant one left out)."""
    grey = picture.mean(2)
    for _ in range(2):
        n = grey.shape[0]
        if n < 32:
            grey = grey[np.arange(32) * n // 32]
        else:
            cuts = np.arange(32) * n // 32
            grey = np.add.reduceat(grey, cuts, 0) / np.diff(np.append(cuts, n))[:, None]
        grey = grey.T
    low = np.round(_DCT @ grey @ _DCT.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def write_media(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``media`` (binary): the text's bytes as a PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                raw, at = data.tobytes(), offs.tolist()
                yield append(part, {"media": pa.array([write_png(padded(raw[a:b])) for a, b in zip(at, at[1:])], pa.binary())})

    return arrow_map(df, run, plus(df.schema, T.StructField("media", T.BinaryType())))


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds ``payload`` (binary), ``width``, ``height``, ``feature`` and ``sound`` of a column of PNGs."""
    fields = [T.StructField("payload", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("feature", T.StringType()), T.StructField("sound", T.BooleanType())]

    def one(raw: bytes | None) -> tuple:
        try:
            picture = read_png(raw or b"")
        except ValueError:
            return None, None, None, None, False
        return picture.tobytes(), picture.shape[1], picture.shape[0], low_frequency_hash(picture), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, media):
                columns = list(zip(*(one(x) for x in part.column(media).to_pylist())))
                yield append(part, {f.name: pa.array(c, t) for f, c, t in zip(fields, columns, (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.bool_()))})

    return arrow_map(df, run, plus(df.schema, *fields))
