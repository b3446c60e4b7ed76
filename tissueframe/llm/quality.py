"""Quality by compression: zstandard dictionaries built from good and from bad labelled texts.

A text that compresses better with the dictionary of good texts than with that of bad ones looks like them. The
difference of the two sizes, over the size without a dictionary, becomes a score by a logistic curve fitted on
labelled texts. Each text is compressed whole, in equal pieces of ``PIECE`` bytes at most, each against the dictionary
anew: in one stream a dictionary saves a bounded number of bytes, and a long text's difference would go to 0.

The dictionaries and the curve take ``PER_CLASS`` texts of each label (expected number; chosen by a hash of the key),
of any length, about half for each (by a hash of the text). A dictionary is filled evenly: every text gives a piece from a
place that its hash gives, all equally long unless it is shorter, out of ``LONGEST`` characters in a row from anywhere in
the text (a parameter of ``fit``, which bounds what comes to the driver). The curve takes every text whole, and only
differences come to the driver. Of rows that share a key, one is taken.

Edge cases: null counts as empty; an empty text has difference 0 and gets the curve's value there. With labels of one
kind, or none, every score is 0.5; a score of exactly 0.5 counts as good. A key that is marked both 0 and 1 counts as 1.
Repeated rows are scored alike; other columns pass through, and columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, arrow_map, plus, slices, text_column
from .langid import platt

PER_CLASS, LONGEST, DICTIONARY, LEVEL, PIECE = 1200, 20_000, 256 << 10, 9, 16 << 10


class Model:
    def __init__(self, good: bytes, bad: bytes, a: float = 0.0, b: float = 0.0) -> None:
        self.good, self.bad, self.a, self.b = good, bad, a, b
        self._tools: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    def differences(self, data: bytes, offs: list[int]) -> np.ndarray:
        """(size with the bad dictionary - size with the good one) / size without, for each text: sums over its pieces."""
        if self._tools is None:
            kind = zstandard.DICT_TYPE_RAWCONTENT
            with_ = [zstandard.ZstdCompressionDict(d, dict_type=kind) for d in (self.good, self.bad)]
            for d in with_:
                d.precompute_compress(level=LEVEL)
            plain = {"write_checksum": False, "write_content_size": False}
            self._tools = tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **plain).compress for d in with_) + (zstandard.ZstdCompressor(level=LEVEL, **plain).compress,)
        good, bad, none = self._tools
        view, out = memoryview(data), np.zeros(len(offs) - 1)
        for r, (a, b) in enumerate(zip(offs, offs[1:])):
            if b > a:
                n = -(-(b - a) // PIECE)
                cuts = [a + (b - a) * i // n for i in range(n + 1)]
                parts = [view[x:y] for x, y in zip(cuts, cuts[1:])]
                out[r] = sum(len(bad(x)) - len(good(x)) for x in parts) / sum(len(none(x)) for x in parts)
        return out

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * difference + self.b, -40, 40)))


def dictionary(texts: list[tuple[int, bytes]], size: int = DICTIONARY) -> bytes:
    """Bytes of all texts, as raw content for the compressor to refer to: equally many of each, from a place that its hash
    gives, or all of a shorter text, ``size`` in all."""
    left, share = size, 0
    for n, length in enumerate(sorted(len(t) for _, t in texts)):
        share = left // (len(texts) - n)
        if length > share:
            break
        left -= length
        share = length
    starts = [h % (len(t) - share + 1) if len(t) > share else 0 for h, t in texts]
    return b"".join(t[a : a + share] for a, (_, t) in zip(starts, texts))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, longest: int = LONGEST) -> Model | None:
    """Fits on rows of ``df`` that ``labels(key, label)`` marks 0 or 1."""
    labels = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in labels.groupBy(label).count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col(label) == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    chosen = labels.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) < share * 1_000_003).groupBy(key).agg(F.max(label).alias("y"))
    # One text a key: of rows that share it, the one with the least hash.
    known = df.filter(F.length(text) > 0).select(key, text).join(F.broadcast(chosen), key).withColumn("h", F.xxhash64(text))
    known = known.groupBy(key).agg(F.min("h").alias("h"), F.first("y").alias("y"), F.min_by(text, "h").alias(text)).select("h", "y", text)
    even = F.pmod("h", F.lit(2)) == 0
    place = F.when(F.length(text) > longest, F.pmod(F.xxhash64("h"), F.length(text) - longest + 1)).otherwise(0) + 1
    first = sorted((h, y, t.encode()) for h, y, t in known.filter(even).select("h", "y", F.substring(F.col(text), place, F.lit(longest))).collect())
    texts = {y: [(h, t) for h, z, t in first if z == y] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        return None
    model = Model(dictionary(texts[1]), dictionary(texts[0]))
    rest = _measured(known.filter(~even), model, text)
    if len({y for _, y, _ in rest}) < 2:
        rest = _measured(known.filter(even), model, text)
    model.a, model.b = balanced(np.array([d for *_, d in rest]), np.array([y for _, y, _ in rest]), counts)
    return model


def _measured(known: DataFrame, model: Model, text: str) -> list[tuple[int, int, float]]:
    """h, y and the difference of each whole text, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_column(batch, text)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y").cast(pa.int64()), pa.array(model.differences(data.tobytes(), offs.tolist()))], ["h", "y", "d"])

    return sorted(tuple(r) for r in arrow_map(known, run, "h long, y long, d double").collect())


def balanced(difference: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> tuple[float, float]:
    """The curve for the labels' own shares: the sample's are evened out by a shift of the log-odds."""
    a, b = platt(difference / (difference.std() or 1.0), y)
    sample = np.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
    return a / (difference.std() or 1.0), b - sample + np.log(counts[1] / counts[0])


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: good likelier) and ``predicted`` (1 from 0.5 on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                s = model.score(model.differences(data.tobytes(), offs.tolist())) if model else np.full(part.num_rows, 0.5)
                yield append(part, {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return arrow_map(df, run, plus(df.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())))
