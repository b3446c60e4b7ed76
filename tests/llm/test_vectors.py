import math

import numpy as np
import pytest

from tissueframe.llm import vectors


def brute(rows, cosine):
    """key -> (links, least key reachable), over all pairs."""
    good = {k: np.array(v, float) for k, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    near = {k: {j for j, b in good.items() if j != k and len(a) == len(b) and a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= cosine} for k, a in good.items()}
    out = {}
    for k, v in rows:
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), set()) - seen:
                seen.add(j)
                todo.append(j)
        out[k] = (len(near.get(k, ())), min(seen))
    return out


def clusters(seed, d=12):
    rng = np.random.default_rng(seed)
    rows = []
    for size, spread in [(1, 0), (60, 0.02), (40, 0.15), (25, 0.3), (1, 0), (30, 0.25)] * 2:
        c = rng.normal(size=d)
        rows += [(c + spread * rng.normal(size=d) * np.linalg.norm(c) / math.sqrt(d)).tolist() for _ in range(size)]
    rows += [rng.normal(size=d).tolist() for _ in range(150)]
    rows += [rows[5]] * 20 + [[3 * x for x in rows[70]]] * 3
    order = rng.permutation(len(rows))
    return [(int(1000 - i), rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize(("seed", "cosine", "tile"), [(1, 0.9, 1 << 20), (2, 0.9, 640), (3, 0.8, 2000), (4, 0.97, 200)])
def test_equals_all_pairs(spark, monkeypatch, seed, cosine, tile):
    monkeypatch.setattr(vectors, "TILE_BYTES", tile)
    odd = [(2001, None), (2002, []), (2003, [0.0] * 12), (2004, [1.0, None] + [0.0] * 10), (2005, [math.nan] * 12), (2006, [math.inf] + [1.0] * 11), (2007, [1.0]), (2008, [2.0]), (2009, [1e200] * 12), (2010, [1e-200] * 12)]
    rows = clusters(seed) + [r for r in odd if r[0] not in (2009, 2010)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows + odd[-2:], "vec_id long, embedding array<double>"), cosine).collect()}
    want = brute(rows, cosine)
    assert {k: (got[k].n_links, got[k].component_id) for k in want} == want
    assert got[2009].n_links >= 1 and got[2010].component_id == got[2009].component_id
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_limit_belongs_to_the_links(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])]
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.6).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_tight_group_counts_whole_intervals(spark, monkeypatch):
    """A group of near copies over many tiles: counts are right, and its pairs are settled above the tiles."""
    monkeypatch.setattr(vectors, "TILE_BYTES", 1 << 10)
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[0] + 1e-3 * rng.normal(size=8)).tolist()) for i in range(600)] + [(600 + i, rng.normal(size=8).tolist()) for i in range(60)]
    met = []
    join = vectors._join_tiles
    monkeypatch.setattr(vectors, "_join_tiles", lambda pairs, *a: met.append(pairs.count()) or join(pairs, *a))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()}
    assert got == brute(rows, 0.95)
    assert met[0] < 400  # of some 860 pairs of tiles


def test_null_and_repeated_keys_clashing_names_empty_table(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, v, 0), (1, v, 1), (None, v, 2), (2, v, 3), (1, w, 4)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, rank int").withColumnRenamed("rank", "copy")
    got = sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True), (2, 1, 1, False), (1, 0, 1, True)], key=repr)
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert vectors.near_vectors(df.filter("vec_id IS NULL")).collect()[0].kept
    with pytest.raises(TypeError):
        vectors.near_vectors(df.withColumn("vec_id", df["vec_id"].cast("double")))
