import random
import uuid
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F

from tissueframe.llm import bpe, token_count, token_output

from .brute import best_pieces, segmentations

RANKS, PIECES = path("byte_bpe_multi_50k.tiktoken"), path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def scores():
    """Log-probabilities of the pieces, from the vocabulary file: -log(rank + 10)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            out.setdefault(sp.id_to_piece(i), -float(np.log(i + 10)))
    return out


def test_trie_equals_all_segmentations(scores):
    rng, m = random.Random(18), token_count.Unigram(PIECES)
    words = sorted({"\u2581" + "".join(rng.choices("abcdeéß中tionsver", k=rng.randint(0, 7))) for _ in range(300)})
    want = [max(segmentations(w, scores), key=lambda s: s[0]) for w in words]
    got = m.trie(words)
    for w, (best, _), n in zip(words, want, got.tolist()):
        # Several segmentations may share the best score; the trie's is one of them.
        assert n in {k for s, k in segmentations(w, scores) if abs(s - best) < 1e-9}, w


@pytest.mark.parametrize(("many", "long"), [(1500, 39), (40, 400), (3, 3000), (1, 2)])
def test_trie_of_any_depth_equals_plain_recurrence(scores, many, long):
    rng, m = random.Random(8), token_count.Unigram(PIECES)
    words = sorted({"\u2581" + "".join(rng.choices("abcdeéß中🙂tionsver", k=rng.randint(1, long))) for _ in range(many)})
    words += ["\u2581" + words[-1][1:] + x for x in ("a", "ation")] + ["\u2581", "\u2581" + "x" * 200]
    words = sorted(set(words))
    assert m.trie(words).tolist() == [best_pieces(w, scores) for w in words]


def test_longest_piece_counts(scores):
    assert token_count.Unigram(PIECES).longest == max(map(len, scores))


def test_counts(spark, scores):
    rows = [(1, "The cat  sat\n on the mat"), (2, None), (3, ""), (4, " \t"), (5, "x" * 3000 + " yes"), (5, "naïve 中文"), (6, "中文没有空格" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS n_tokens")
    got = sorted((r.doc_id, r.n_pretokens, r.n_tokens) for r in token_count.count_tokens(df, PIECES).collect())
    assert got == sorted((d, len((t or "").split()), sum(best_pieces("\u2581" + w, scores) for w in (t or "").split())) for d, t in rows)
    assert token_count.count_tokens(df.limit(0), PIECES).count() == 0


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        for key in (1, 2):
            assert sorted(token_output.feistel(np.arange(n), n, key).tolist()) == list(range(n))
    assert (token_output.feistel(np.arange(100), 100, 1) != token_output.feistel(np.arange(100), 100, 2)).any()


def texts_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.number):
        ids = np.frombuffer(r.ids, "<u2")
        assert (ids[r.used :] == 50256).all()
        out.setdefault(r.key, []).extend(ids[: r.used].tolist())
    return out


def test_shards(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(60)] + [(None, None), (7, "text number 7 "), (-1, "minus one"), (90, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS record").repartition(5)
    folder = token_output.write_shards(df, RANKS, f"file://{tmp_path}/shards", length=16, per_shard=7)
    assert token_output.write_shards(df, RANKS, folder, length=16, per_shard=7) == folder
    got = token_output.read_shards(spark, folder).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got))) and {r.slot // 7 == r.shard for r in got} == {True}
    texts, c = texts_of(got), bpe.codec(RANKS)
    for d, t in rows:
        if d != 7:
            assert texts[d] == [*c.encode([t or ""])[0].tolist(), 50256]
    assert min(r.slot for r in token_output.read_shards(spark, folder, 30).collect()) == 30
    assert not (tmp_path / "shards" / "sequences").exists()
    empty = token_output.write_shards(df.limit(0), RANKS)
    assert token_output.read_shards(spark, empty).count() == 0

def test_passes_share_the_shuffle_and_give_it_back(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(rng.randint(0, 400)))) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"file://{tmp_path}/texts")
    df = spark.read.parquet(f"file://{tmp_path}/texts")
    tops = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {str(f): f.stat().st_size for top in tops for f in Path(top).rglob("shuffle_*.data")}
    before, seen, write, table = set(files()), tmp_path / "seen", token_output.filled, tmp_path / "shards" / "sequences"
    seen.mkdir()

    def filled(raw, offs, order, length, end, width):
        new = sum(n for f, n in files().items() if f not in before)
        (seen / uuid.uuid4().hex).write_text(f"{new} {sum(f.stat().st_size for f in table.glob('part-*'))}")
        return write(raw, offs, order, length, end, width)

    monkeypatch.setattr(token_output, "filled", filled)
    monkeypatch.setattr(token_output, "PART_BYTES", 1 << 18)
    folder = token_output.write_shards(df, RANKS, f"file://{tmp_path}/shards", per_shard=64)
    got = token_output.read_shards(spark, folder).collect()
    texts, c = texts_of(got), bpe.codec(RANKS)
    assert len(texts) == 2000 and all(texts[d] == [*c.encode([t])[0].tolist(), 50256] for d, t in rows)
    assert sorted(r.slot for r in got) == list(range(len(got)))
    shuffled, kept = zip(*(map(int, f.read_text().split()) for f in seen.iterdir()))
    assert len(shuffled) == -(-len(got) // 64) and 0 < max(shuffled) < 0.8 * max(kept)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_interrupted_run_goes_on_under_another_partitioning(spark, tmp_path, monkeypatch):
    rows = [(i, f"document {i} says {i * 7} things " * (1 + i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder, write = f"file://{tmp_path}/shards", token_output.filled

    def breaks(raw, offs, order, length, end, width):
        if order[0] % 3 == 0:
            raise OSError("lost")
        return write(raw, offs, order, length, end, width)

    monkeypatch.setattr(token_output, "filled", breaks)
    with pytest.raises(Exception, match="lost"):
        token_output.write_shards(df.repartition(5), RANKS, folder, length=16, per_shard=7)
    monkeypatch.undo()
    with pytest.raises(ValueError, match="no finished run"):
        token_output.read_shards(spark, folder)
    for other in ({"seed": 2}, {"length": 8}):
        with pytest.raises(ValueError, match="other parameters"):
            token_output.write_shards(df, RANKS, folder, **({"length": 16, "per_shard": 7} | other))
    with pytest.raises(ValueError, match="other input"):
        token_output.write_shards(df.withColumn("text", F.concat("text", F.lit("x"))), RANKS, folder, length=16, per_shard=7)
    token_output.write_shards(df.repartition(3), RANKS, folder, length=16, per_shard=7)
    got = token_output.read_shards(spark, folder).collect()
    texts, c = texts_of(got), bpe.codec(RANKS)
    assert len(texts) == 200 and all(texts[d] == [*c.encode([t])[0].tolist(), 50256] for d, t in rows)
    assert sorted(r.slot for r in got) == list(range(len(got)))
    (tmp_path / "shards" / "manifest.json").unlink()
    with pytest.raises(ValueError, match="without a manifest"):
        token_output.write_shards(df, RANKS, folder, length=16, per_shard=7)
