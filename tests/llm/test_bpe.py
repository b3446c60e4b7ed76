import random

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path

from tissueframe.llm import bpe

RANKS = path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS)


@pytest.fixture(scope="module")
def brute(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def same(codec, brute, texts):
    ids, at = codec.encode(texts)
    for k, t in enumerate(texts):
        own = ids[at[k] : at[k + 1]].tolist()
        assert own == brute.encode_ordinary(t), repr(t[:200])
        assert bytes(codec.decode(np.array(own, np.int64))[0]) == t.encode()


def test_random_texts_match_the_library(codec, brute):
    rng = random.Random(5)
    bits = ["'", "s", "t", "re", "'ll", "'ve", " ", "  ", "\n", "\t", "\r\n", " ", "　", "é", "Ä", "中文", "٣", "½", "7", "42", "!", "...", "🙂", "a", "Bc", "\0", "\x1c", "​", "é"]
    for _ in range(60):
        same(codec, brute, ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(50)])


def test_edges(codec, brute):
    same(codec, brute, ["", "'", "''s", " 's", "x's y", "'re", "'r", "a  b", " ", "  ", "\n\n a", "a " * 3000, "ab" * 4000, "1" * 5000, "a\0b", "\0"])
    same(codec, brute, ["" for _ in range(5)])


def test_all_codepoint_classes(codec, brute):
    rng = random.Random(1)
    points = [chr(c) for c in rng.sample([*range(0x0, 0xD800), *range(0xE000, 0x20000)], 6000)]
    same(codec, brute, ["".join(a + "a1 " for a in points[i : i + 100]) for i in range(0, len(points), 100)])


def test_scan_equals_sequential_automaton():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 9, 700_000).astype(np.uint8)
    state, want = bpe.FRESH, []
    for k in kinds[:5000]:
        want.append(state)
        state = bpe.STEP[state, k]
    assert bpe.scan_states(kinds[:5000]).tolist() == [int(x) for x in want]
    assert (bpe.scan_states(kinds, 64) == bpe.scan_states(kinds, 4096)).all()


def test_spark_rows(spark):
    df = spark.createDataFrame([(1, "It's a test", "k"), (2, None, "k"), (3, "", "k"), (3, "", "k")], "doc_id long, text string, ids string")
    rows = bpe.digests(bpe.decode(bpe.encode(df, RANKS), RANKS)).collect()
    assert sorted((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in rows) == [(1, 4, b"It's a test"), (2, 0, b""), (3, 0, b""), (3, 0, b"")]
    assert next(r.byte_offsets for r in rows if r.doc_id == 1) == [0, 2, 4, 6]
    assert bpe.encode(df.limit(0), RANKS).count() == 0
