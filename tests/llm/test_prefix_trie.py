import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tissueframe.llm import prefix_trie as pt
from tissueframe.workspace import Workspace


def brute(convs):
    """conv -> list of (role, text) as rows of the contract, by walking all prefixes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(o[:-1] == k for o in members if o)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(key))))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=60):
    rng, convs = random.Random(seed), {}
    for c in range(n):
        base = rng.choice(list(convs.values())) if convs and rng.random() < 0.8 else []
        convs[c * 7 % (2 * n)] = base[: rng.randrange(len(base) + 1)] + [(rng.choice(["user", "bot"]), rng.choice(["a", "bé", "", "c" * 9])) for _ in range(rng.choice([0, 1, 2, 5]))]
    return convs


def table(spark, convs):
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.createDataFrame([(c,) for c in convs], "conv long")


@pytest.mark.parametrize(("seed", "stretch", "shards"), [(1, 1024, 1), (2, 2, 7), (3, 3, 40)])
def test_equals_walking_all_prefixes(spark, monkeypatch, seed, stretch, shards):
    monkeypatch.setattr(pt, "STRETCH", stretch)
    convs = conversations(seed)
    totals = pt.subtree_totals
    monkeypatch.setattr(pt, "subtree_totals", lambda nodes, work: totals(nodes, work, shards))
    turns, ids = table(spark, convs)
    got = pt.prefix_trie(pt.positions(turns), ids)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(convs)


def test_long_shared_chain_over_many_shards(spark, monkeypatch):
    """Each conversation goes on from the last one, so paths cross all shards; one is long, and many are alike."""
    monkeypatch.setattr(pt, "STRETCH", 16)
    convs = {c: [("u", str(i)) for i in range(3 * c)] for c in range(14)} | {100 + c: [("u", "0")] for c in range(30)}
    totals = pt.subtree_totals
    monkeypatch.setattr(pt, "subtree_totals", lambda nodes, work: totals(nodes, work, 9))
    turns, ids = table(spark, convs)
    assert sorted((tuple(r) for r in pt.prefix_trie(pt.positions(turns), ids).collect()), key=repr) == brute(convs)


@pytest.mark.parametrize("limit", [1, 5, 10_000])
def test_queue_spills_and_keeps_order(limit):
    rng = np.random.default_rng(limit)
    queue = pt.SpillingQueue(1, limit)
    keys = rng.integers(-50, 50, 300)
    for a in range(0, 300, 7):
        queue.push(keys[a : a + 7], np.arange(a, min(a + 7, 300)))
    queue.next_level()
    got = [queue.pull(k) for k in (-60, -20, -20, 3, 99)]
    assert not len(got[0]) and not len(got[2]) and (queue.spilled > 0) == (limit < 300)
    rows = np.concatenate(got)
    assert (np.diff(rows[:, 0]) >= 0).all() and sorted(map(tuple, rows)) == sorted(zip(keys, range(300)))


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_passes_are_alike_in_any_batches(size):
    """A chain with side branches, cut into batches of any size, with a spilling queue."""
    rows = [(0, d, 0, 0, True, d > 0, 0, 1) for d in range(40)] + [(0, d, d, 0, True, True, 0, 2) for d in range(1, 40)] + [(0, 5, 99, 0, False, False, 3, 10)]
    names = ["shard", "depth", "conv", "parent", "own", "inside", "leaves", "saved"]

    def batches(order):
        ordered = sorted(rows, key=order)
        for a in range(0, len(ordered), size):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in ordered[a : a + size]])

    up = {(r["conv"], r["depth"]): r for b in pt.send_up(batches(lambda r: (r[0], -r[1], r[2])), False, 3) for r in b.to_pylist()}
    assert up[0, 0]["n_leaves"] == 39 + 1 + 3 - 0 and up[0, 0]["saved_tokens"] == 40 + 2 * 39 + 10 and up[0, 4]["n_children"] == 3
    down = [r for b in pt.send_down(batches(lambda r: (r[0], r[1], r[3])), 3) for r in b.to_pylist()]
    assert down == [{"conv": 99, "depth": 5, "root_conv": 0, "root_depth": 0}]


def test_nulls_ties_empty_table_and_other_columns(spark):
    rows = [(1, None, "user", "first", 0), (1, 0, None, None, 0), (2, None, "user", "first", 0), (2, 5, "", "", 0), (None, 0, "user", "lost", 0), (3, 1, "user", "x", 0), (3, 1, "user", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = sorted((tuple(r)[:7] for r in pt.prefix_trie(pt.positions(df), spark.createDataFrame([(1,), (2,), (3,), (4,)], "conv long")).collect()), key=repr)
    assert got == sorted([(1, 0, None, 4, 2, 2, 5), (1, 1, 1, 2, 1, 1, 5), (1, 2, 1, 2, 0, 1, 0), (3, 1, 1, 1, 1, 1, 0), (3, 2, 3, 1, 0, 1, 0)], key=repr)
    none = pt.positions(df.limit(0))
    assert pt.prefix_trie(none, none.select("conv")).count() == 0
    alone = pt.prefix_trie(none, spark.createDataFrame([(7,)], "conv long")).collect()
    assert [tuple(r) for r in alone] == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_totals_do_not_depend_on_shards(spark):
    rng = random.Random(4)
    rows, paths = [(0, 0, None, 0)], {0: (0, 0)}
    for c in range(1, 50):
        parent = rng.choice(list(paths))
        d = rng.randint(*paths[parent])
        paths[c] = (d + 1, d + rng.randrange(1, 6))
        rows += [(c, k, parent if k == d + 1 else c, rng.randrange(5)) for k in range(paths[c][0], paths[c][1] + 1)]
    nodes = spark.createDataFrame(rows, "conv long, depth long, parent long, saves long")
    one, many = (sorted(tuple(r) for r in pt.subtree_totals(nodes, Workspace(spark), s).collect()) for s in (1, 23))
    assert one == many and len(one) == len(rows) and one[0][4] == sum(r[3] for r in rows)
