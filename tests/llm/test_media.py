import struct
import zlib

import numpy as np
import pytest

from tissueframe.llm import media


def test_round_trip():
    rng = np.random.default_rng(1)
    for raw in (b"", b"a", b"x" * 191, b"x" * 192, b"x" * 193, rng.bytes(50_000), ("Grüße " * 3000).encode()):
        payload = media.padded(raw)
        assert len(payload) % 192 == 0 and payload.startswith(raw) and len(payload) >= 192
        assert media.read_png(media.write_png(payload)).tobytes() == payload


def plain_unfilter(kinds, rows, step):
    out, kinds, rows = np.zeros(rows.shape, int), kinds.tolist(), rows.astype(int)
    for r, k in enumerate(kinds):
        for i in range(rows.shape[1]):
            a = out[r, i - step] if i >= step else 0
            b = out[r - 1, i] if r else 0
            c = out[r - 1, i - step] if r and i >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[r, i] = (rows[r, i] + [0, a, b, (a + b) // 2, paeth][k]) % 256
    return out


@pytest.mark.parametrize("most", [3, 5])
def test_all_filters(most):
    rng = np.random.default_rng(most)
    for step in (1, 3, 4):
        kinds, rows = rng.integers(0, most, 12).astype(np.uint8), rng.integers(0, 256, (12, step * 7)).astype(np.uint8)
        assert (media.unfilter(kinds, rows, step) == plain_unfilter(kinds, rows, step)).all()


def test_damage_is_found():
    good = media.write_png(media.padded(b"hello " * 100))
    for i in range(0, len(good), 7):
        bad = good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :]
        with pytest.raises(ValueError):
            media.read_png(bad)
    for cut in (0, 7, 20, len(good) - 1):
        with pytest.raises(ValueError):
            media.read_png(good[:cut])
    lie = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 9, 8, 2, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(b"x")) + media._chunk(b"IEND", b"")
    with pytest.raises(ValueError):
        media.read_png(lie)


def test_spark_rows(spark):
    df = spark.createDataFrame([(1, "a" * 100_000, "k"), (2, None, "k"), (3, "", "k"), (3, "", "k")], "doc_id long, text string, sound string")
    rows = media.read_media(media.write_media(df)).collect()
    assert {r.doc_id: len(r.payload) for r in rows} == {1: 100_032, 2: 192, 3: 192} and all(r.sound for r in rows)
    assert len({(bytes(r.media), r.feature) for r in rows if r.doc_id > 1}) == 1
    bad = media.read_media(spark.createDataFrame([(1, bytearray(b"no")), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.sound, r.payload) for r in bad] == [(False, None)] * 2
    assert media.read_media(media.write_media(df.limit(0))).count() == 0


def plain_hash(picture):
    """The cosine hash, sum by sum."""
    grey = picture.mean(2)
    for _ in range(2):
        n = len(grey)
        cuts = [k * n // 32 for k in range(33)]
        grey = np.array([grey[cuts[k] : max(cuts[k] + 1, cuts[k + 1])].mean(0) for k in range(32)]).T
    low = [round(sum(grey[i, j] * np.cos(np.pi / 32 * (i + 0.5) * u) * np.cos(np.pi / 32 * (j + 0.5) * v) for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = np.median(low[1:])
    return f"{int(''.join('1' if x > middle else '0' for x in low), 2):016x}"


@pytest.mark.parametrize("shape", [(32, 32, 1), (40, 70, 3), (7, 64, 1), (100, 33, 4)])
def test_hash_equals_a_plain_version(shape):
    picture = np.random.default_rng(sum(shape)).integers(0, 256, shape).astype(np.uint8)
    assert media.low_frequency_hash(picture) == plain_hash(picture)
