import random

import pytest

from tissueframe.llm import neardup

from .brute import groups


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    while len(rows) < n:
        base = rng.choices(vocab, k=rng.choice([1, 2, 3, 8, 40, 120]))
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((doc, rng.choice([" ", "  ", "\n"]).join(t).replace("w1", rng.choice(["w1", "W1"]))))
            doc += 1
    return rows


@pytest.mark.parametrize(("seed", "k", "percent", "block"), [(1, 3, 85, 192), (2, 5, 80, 64), (3, 3, 60, 8)])
def test_equals_all_pairs(spark, monkeypatch, seed, k, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = [*corpus(seed), (9001, None), (9002, ""), (9003, " \n"), (9004, "x"), (9005, "X")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hot_copies_long_text_nulls_and_other_columns(spark):
    near = [(i, " ".join(f"t{(j if j != i % 50 else j + 1000 + i)}" for j in range(60)), "h") for i in range(300)]
    rows = [*near, *[(1000 + i, "same words here again", "h") for i in range(500)], (2000, "z " * 50_000, "h"), (None, "same words here again", "h"), (7, near[7][1], "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bands string").withColumnRenamed("bands", "n")
    got = neardup.near_duplicates(df, 3, 85).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].component_id for i in range(300)} == {0} and {by[1000 + i].component_id for i in range(500)} == {1000}
    assert by[None].component_id is None and by[None].kept and by[2000].n_shingles == 1
    kept = neardup.keep_one(df, 3, 85).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1000, 2000] and len(kept) == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(df).count() == 0 and neardup.keep_one(df).count() == 0


@pytest.mark.parametrize("bits", [1 << 6, 1 << 12, 1 << 26])
def test_rows_without_keys(spark, monkeypatch, bits):
    """Whatever the filter lets through, the rows are those of an anti join; column names may clash."""
    from tissueframe.llm import common

    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = [(k if k % 7 else None, f"t{k}", k) for k in range(3000)] + [(5, "again", 0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, mask int")
    gone = spark.createDataFrame([(k,) for k in range(0, 9000, 5)], "doc_id long")
    got = common.without(df, gone, "doc_id")
    assert got.columns == df.columns
    assert sorted(r.text for r in got.collect()) == sorted(t for k, t, _ in rows if k is None or k % 5)
