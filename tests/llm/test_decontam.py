import random

import numpy as np
import pytest

from tissueframe.llm import decontam

from .brute import leaks


def test_equals_all_windows(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([2, 4, 5, 14, 30, 59])))) for i in range(25)] + [(90, None), (91, "")]
    items.append((92, "ab ab ab ab ab ab ab ab ab"))
    docs = [(1000, None), (1001, ""), (1002, "ab " * 30), (1003, "AB " * 8)]
    for d in range(120):
        t = rng.choices(vocab, k=rng.randint(0, 80))
        if d % 2:
            w = items[rng.randrange(25)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "edit"
            at = rng.randint(0, len(t))
            t = t[:at] + w[rng.choice([0, 0, 1]) :] + t[at:]
        docs.append((d, " ".join(t)))
    want = leaks(docs, items)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS windows")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_leaks(df, bench).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 30
    kept = {r.doc_id for r in decontam.drop_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_many_items_of_one_size_and_repeated_rows(spark):
    """Thousands of items of one length, a third of them copies of one, and repeated documents: a row each."""
    rng = random.Random(14)
    items = [(i, " ".join(f"m{rng.randrange(5000)}" for _ in range(40))) for i in range(3000)]
    items += [(3000 + i, items[0][1].upper()) for i in range(1500)]
    docs = [(d, f"start {items[d * 7][1]} end") for d in range(60)] + [(0, f"start {items[0][1]} end")] + [(500, " ".join(f"m{rng.randrange(5000)}" for _ in range(4000)))]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(d, d * 7) for d in range(60)] + [(0, 0)] + [(0, 3000 + i) for i in range(1500)] * 2
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    assert {r.first_word for r in got} == {1} and {r.similarity for r in got} == {1.0}


def test_blocks_find_all_prints_within_the_radius():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 16, decontam.BITS // 16, dtype=np.uint16)
    flips = [rng.permutation(decontam.BITS)[:n] for n in rng.integers(0, 120, 400)] + [np.arange(68), np.arange(69)]
    bits = np.unpackbits(np.stack([one] * len(flips)).view(np.uint8), axis=1)
    for r, f in enumerate(flips):
        bits[r, f] ^= 1
    prints = np.packbits(bits, axis=1).view(np.uint16)
    assert decontam.within(prints, one).tolist() == [r for r, f in enumerate(flips) if len(f) <= decontam.RADIUS]


def test_similar_windows_lie_within_the_radius():
    """The radius loses no window at the least similarity, for items of distinct shingles of many sizes."""
    rng = np.random.default_rng(9)
    for n in (9, 18, 45, 90, 450):
        far = 0
        for _ in range(60):
            own = rng.integers(1, 1 << 62, 2 * n, dtype=np.uint64)
            shared = decontam.need(n, n, 80)
            a, b = own[:n], np.concatenate([own[:shared], own[n : 2 * n - shared]])
            x, y = (decontam.fingerprints(s, np.zeros(1, np.int64), n) for s in (a, b))
            far = max(far, int(np.bitwise_count(x ^ y).sum()))
        assert far <= decontam.RADIUS, n


def test_empty_tables_and_long_text(spark):
    docs, items = spark.createDataFrame([(None, "a b c d e f " * 20_000)], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f a b c d e f")], "item_id long, text string")
    row = decontam.find_leaks(docs, items).first()
    assert row.doc_id is None and row.similarity == 1.0 and row.windows > 10_000
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), items).count() == 0
    assert decontam.drop_leaks(docs, items).count() == 1


def test_repeated_shingles(spark):
    """Long items quoted to 80 % and followed, or mixed, with one repeated word; and items that repeat themselves."""
    rng = random.Random(8)
    items = [(i, " ".join(f"q{i}x{j}" for j in range(size))) for i, size in enumerate((59, 104, 304))]
    items += [(10, " ".join(["row"] * 60 + [f"z{j}" for j in range(140)])), (11, " ".join(f"p{j % 7}" for j in range(150)))]
    docs = []
    for i, text in items:
        w = text.split()
        for k, share in enumerate((0.78, 0.82, 0.9, 1.0)):
            kept = w[: round(len(w) * share)]
            docs += [(100 * i + k, " ".join(kept + ["na"] * (len(w) + 20))), (100 * i + 10 + k, " ".join(["la"] * len(w) + kept + ["-"] * len(w)))]
        docs += [(100 * i + 20, " ".join(w[: len(w) // 2] + ["x"] + w[len(w) // 2 :])), (100 * i + 21, " ".join(rng.sample(w, len(w))))]
    want = leaks(docs, items)
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == set(want) and all(abs(got[k].similarity - want[k]) < 1e-12 for k in want) and len(want) > 20
    assert got[3, 0].first_word == 0 and got[3, 0].windows == 7 and got[203, 2].windows == 34


def test_prints_of_far_windows_take_little_memory():
    """Two hits 800,000 words apart: what is in between isn't worked on, and prints equal sums over whole windows."""
    import tracemalloc

    rng = np.random.default_rng(6)
    item = rng.integers(1, 1 << 62, 100, dtype=np.uint64)
    own = rng.integers(1, 1 << 62, 800_200, dtype=np.uint64)
    own[:100], own[-100:] = item, item
    mark = decontam.fingerprints(item, np.zeros(1, np.int64), 100)[0]
    tracemalloc.start()
    found = decontam.compare(own, False, item, mark, False, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] > 2 and found[1:] == (0, 1.0) and peak < 200e6
    bits = np.concatenate([np.unpackbits(decontam.mix(own[:300] ^ np.uint64(s)).view(np.uint8).reshape(-1, 8), axis=1) for s in decontam.SEEDS], 1).astype(int) * 2 - 1
    starts = np.array([0, 3, 150])
    want = np.stack([np.packbits(bits[s : s + 70].sum(0) > 0) for s in starts]).view(np.uint16)
    assert (decontam.fingerprints(own[:300], starts, 70) == want).all()


def test_document_of_all_items_sends_pieces(spark, monkeypatch):
    """A document that holds every item is one stretch; what goes to the comparison grows with the items, not with their
    square. Long items beside it, and items quoted twice."""
    rng = random.Random(21)
    items = [(i, " ".join(f"i{i}x{j}" for j in range(rng.choice([7, 20, 21, 22, 60])))) for i in range(150)] + [(900, " ".join(f"long{j}" for j in range(1500)))]
    whole = " ".join(t for _, t in items)
    docs = [(1, whole), (2, whole.upper() + " " + items[3][1]), (3, " ".join(items[900 - 750][1].split()[:1300]))]
    sent = []
    verified = decontam._verified
    monkeypatch.setattr(decontam, "_verified", lambda pairs, percent: sent.append(pairs.selectExpr("sum(size(own))").first()[0]) or verified(pairs, percent))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_leaks(df, bench).collect()}
    want = leaks(docs, items)
    assert got == pytest.approx(want) and len(want) > 300
    assert sent[0] < 8 * sum(len(t.split()) for _, t in docs)


def test_classes_of_sizes():
    sizes = sorted({1, 2, 3, 8, 9, 10, *range(100, 200)})
    classes = decontam.size_classes(sizes)
    assert [m for m in sizes if sum(a <= m <= b for a, b in classes) != 1] == []
    assert all(8 * b <= 9 * a for a, b in classes) and len(classes) < 16


def test_keys_that_are_no_whole_numbers(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for key in (1.5, "x"):
        with pytest.raises(TypeError):
            decontam.find_leaks(spark.createDataFrame([(key, "a")], ["doc_id", "text"]), items)


def test_small_tables_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, tables of a small benchmark and few leaks are a few files, with the same rows."""
    rng = random.Random(31)
    items = [(i, " ".join(f"f{rng.randrange(900)}" for _ in range(30))) for i in range(120)]
    items += [(200 + i, items[i][1].title()) for i in range(40)]
    docs = [(d, f"start {items[d % 120][1]} between {items[d % 7][1]} end") for d in range(100)] + [(d, items[5][1]) for d in range(300, 340)]
    wide = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wide}
    written, write = [], decontam.Workspace.write
    monkeypatch.setattr(decontam.Workspace, "write", lambda self, df, **options: written.append(write(self, df, **options)) or written[-1])
    try:
        for name, value in wide.items():
            spark.conf.set(name, value)
        found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string").coalesce(2))
        got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
        parts = found.rdd.getNumPartitions()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    held = [(d, {d % 120, d % 7}) for d in range(100)] + [(d, {5}) for d in range(300, 340)]
    assert got == {(d, i): 1.0 for d, own in held for x in own for i in (x, 200 + x) if i < 120 or x < 40}
    assert sum(len(w.inputFiles()) for w in written) <= 12 and parts <= 2
