"""Chat formatting by columnar byte assembly, with a loss mask, and reading it back.

A turn becomes ``<|start|>role<|message|>text<|end|>``; a conversation is its turns in a row. Inside roles and texts a
backslash goes after the ``<`` of every ``<``, backslashes, ``|``, so no control string can occur there and removing one
backslash restores them. The loss mask covers what stands for an assistant's text. Lengths, offsets and scatter indices
of all parts are computed in numpy and copied into one buffer, which becomes the Arrow column as it is.

Each turn is formatted where it lies, without a shuffle; a conversation of any length is later read in order as a
stream, never as one value. Turns go by number (null first), then by formatted text.

Edge cases: null roles and texts count as empty; repeated turns are kept; other columns pass through, and columns named
like the outputs are replaced; turns with a null conversation form one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append, arrow_map, plus, slices, text_column

START, MESSAGE, END = b"<|start|>", b"<|message|>", b"<|end|>"
ASSISTANT = b"assistant"


def _openers(data: np.ndarray, offs: np.ndarray, least: int) -> np.ndarray:
    """Where a ``<`` is followed by ``least`` backslashes at least and then ``|``, within a row."""
    bars = np.flatnonzero(data == 124)
    bars = bars[bars > 0]
    if not len(bars):
        return bars
    last = np.maximum.accumulate(np.where(data != 92, np.arange(len(data)), -1))[bars - 1]
    row = offs[np.searchsorted(offs, bars, "right") - 1]
    ok = (last >= row) & (bars - last > least) & (data[np.maximum(last, 0)] == 60)
    return last[ok]


def escape(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = _openers(data, offs, 0)
    return (np.insert(data, at + 1, 92), offs + np.searchsorted(at, offs)) if len(at) else (data, offs)


def unescape(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = _openers(data, offs, 1)
    return (np.delete(data, at + 1), offs - np.searchsorted(at, offs)) if len(at) else (data, offs)


def _ragged(to: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of ``length`` places from each of ``to``."""
    return np.repeat(to - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def assemble(parts: list[bytes | tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """One buffer in which each row holds a constant or the row of a column for each part; its row offsets, and where
    each part starts in each row."""
    sizes = np.stack([np.full(rows, len(p), np.int64) if isinstance(p, bytes) else np.diff(p[1]) for p in parts], 1)
    ends = np.cumsum(sizes.ravel())
    starts = (ends - sizes.ravel()).reshape(rows, -1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, p in enumerate(parts):
        if isinstance(p, bytes):
            out[(starts[:, k, None] + np.arange(len(p))).ravel()] = np.tile(np.frombuffer(p, np.uint8), rows)
        else:
            out[_ragged(starts[:, k], sizes[:, k])] = p[0]
    return out, np.append(starts[:, 0], len(out)), list(starts.T)


def _equal(data: np.ndarray, offs: np.ndarray, word: bytes) -> np.ndarray:
    same = np.diff(offs) == len(word)
    for k, c in enumerate(word):
        same[same] = data[offs[:-1][same] + k] == c
    return same


def format_turns(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Adds ``formatted`` (string) and ``loss_start``, ``loss_end``: the bytes of it under the loss mask, null if none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                n, roles = part.num_rows, text_column(part, role)
                out, at, starts = assemble([START, escape(*roles), MESSAGE, escape(data, offs), END], n)
                trained = _equal(*roles, ASSISTANT)
                string = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])
                mask = [pa.array(starts[k] - at[:-1], mask=~trained) for k in (3, 4)]
                yield append(part, {"formatted": string, "loss_start": mask[0].cast(pa.int32()), "loss_end": mask[1].cast(pa.int32())})

    return arrow_map(df, run, plus(df.schema, T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.IntegerType()), T.StructField("loss_end", T.IntegerType())))


def parse(data: np.ndarray, offs: np.ndarray) -> tuple[tuple, tuple]:
    """Roles and texts (bytes and offsets each) of formatted turns, one a row."""
    marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)).reshape(-1, 3)
    out = []
    for a, skip, b in ((0, START, 1), (1, MESSAGE, 2)):
        lo = marks[:, a] + len(skip)
        size = marks[:, b] - lo
        out.append(unescape(data[_ragged(lo, size)], np.concatenate([[0], np.cumsum(size)])))
    return out[0], out[1]


def digest_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """For each conversation of formatted turns, read back: number of turns, digests of all roles and texts and of what
    is under the loss mask, and lengths in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        held: list | None = None

        def done() -> pa.RecordBatch:
            k, n, turns, chars, loss, size = held
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((k, n, turns.hexdigest(), chars, loss.hexdigest(), size), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names)

        for batch in batches:
            for part, data, offs in slices(batch, "formatted"):
                roles, texts = parse(data, offs)
                role, said = roles[0].tobytes(), texts[0].tobytes()
                raw, points = data.tobytes(), np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                keys = part.column("conv").to_pylist()
                spans = list(zip(part.column("loss_start").to_pylist(), part.column("loss_end").to_pylist()))
                for r, key in enumerate(keys):
                    if held is None or held[0] != key:
                        if held is not None:
                            yield done()
                        held = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    held[1] += 1
                    held[2].update(b"%b\n%b\n" % (role[roles[1][r] : roles[1][r + 1]], said[texts[1][r] : texts[1][r + 1]]))
                    if spans[r][0] is not None:
                        own = np.frombuffer(raw[offs[r] + spans[r][0] : offs[r] + spans[r][1]], np.uint8)
                        own = unescape(own, np.array([0, len(own)]))[0]
                        held[3] += int(((own & 0xC0) != 0x80).sum())
                        held[4].update(own.tobytes())
                    held[5] += int(points[offs[r + 1]] - points[offs[r]])
        if held is not None:
            yield done()

    rows = df.selectExpr(f"cast(`{conv}` as long) AS conv", f"`{turn}` AS turn", "formatted", "loss_start", "loss_end")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "formatted")
    return arrow_map(rows.select("conv", "formatted", "loss_start", "loss_end"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
