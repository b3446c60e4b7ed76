"""Analytic cases and invariants of operators whose results SQL can't give, and of edge cases."""

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissueframe.functions.linalg import eigenvalues, eigenvector
from tissueframe.operators import cohort, graph, labels, mesh, scoring, spatial, voting, voxels
from tissueframe.plans import incremental
from tissueframe.sources import files
from tissueframe.workspace import Workspace


def block(spark, n, fn, columns="specimen int, x int, y int, z int, label int"):
    return spark.createDataFrame([(0, x, y, z, fn(x, y, z)) for x in range(n) for y in range(n) for z in range(n)], columns)


def test_identical_segmentations_score_one(spark):
    v = block(spark, 6, lambda x, y, z: 1 + x // 3 + 2 * (y // 3)).selectExpr("specimen", "label AS pred", "label AS gt")
    o = scoring.label_overlap(v, ["specimen"])
    assert scoring.dice(o, ["specimen"]).first()["dice"] == 1.0
    assert scoring.volume_jaccard(o, ["specimen"]).first()["vji"] == 1.0
    stats = scoring.segmentation_stats(o, ["specimen"]).first()
    assert (stats.correct, stats.total, stats.missing) == (100.0, 4, 0.0)


def test_states(spark):
    pairs = [(1, 1, 10), (2, 2, 5), (3, 2, 4), (4, 4, 6), (4, 5, 5), (6, 0, 9), (0, 7, 9), (8, 8, 5), (8, 0, 5)]
    v = spark.createDataFrame([(0, p, g) for p, g, n in pairs for _ in range(n)], "specimen int, pred long, gt long")
    got = {(r.side, r.label): r.state for r in scoring.segmentation_states(scoring.label_overlap(v, ["specimen"]), ["specimen"]).collect()}
    assert got[("target", 1)] == "correct" and got[("target", 2)] == got[("target", 3)] == "over_segmented"
    assert got[("target", 4)] == got[("reference", 5)] == "under_segmented" and got[("target", 6)] == "background" and got[("reference", 7)] == "missing"


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((1, 0), (40, 30), (200, 150), (60, 400)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)]
        parent = {x: x for e in edges for x in e}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nearest_join_is_exact_beyond_the_first_buckets(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 3, (80, 3)), np.vstack([rng.normal(0, 1, (30, 3)), [[400, 0, 0], [0, 0, 0], [0, 0, 0]]])
    a = np.vstack([a, [[350, 5, 0], [0, 0, 0]]])
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "pid long, x double, y double, z double")
    tgt = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "tid long, x double, y double, z double")
    got = {r.pid: (r.tid, r.dist) for r in spatial.nearest_join(pts, tgt, 0.5).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert {k: v[0] for k, v in got.items()} == {i: int(x.argmin()) for i, x in enumerate(d)}
    assert spatial.nearest_join(pts, tgt.limit(0), 0.5).count() == 0


def test_eigen_columns(spark):
    rng = np.random.default_rng(2)
    mats = [m @ m.T for m in rng.normal(size=(20, 3, 3))] + [np.eye(3), np.diag([3.0, 1, 1]), np.zeros((3, 3))]
    df = spark.createDataFrame([(i, *map(float, (m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2]))) for i, m in enumerate(mats)], "i int, a double, b double, c double, d double, e double, f double")
    six = [F.col(c) for c in "abcdef"]
    e = eigenvalues(*six)
    for r in df.select("i", e.alias("vals"), eigenvector(e[0], *six).alias("v")).collect():
        want = np.sort(np.linalg.eigvalsh(mats[r.i]))[::-1]
        assert np.allclose(r.vals, want, atol=1e-6 * max(1, want[0]))
        v = np.array(r.v)
        assert np.allclose(mats[r.i] @ v, r.vals[0] * v, atol=1e-5 * max(1, want[0])) and abs(np.linalg.norm(v) - 1) < 1e-9


def tetrahedron(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 2, 1, 7), (1, 0, 1, 3, 7), (2, 0, 3, 2, 7), (3, 1, 2, 3, 7)], "fid long, v0 long, v1 long, v2 long, cell_id long")
    return v, f


def test_tetrahedron(spark):
    v, f = tetrahedron(spark)
    assert mesh.closed_surface(f, ["cell_id"]).first()["closed"] and not mesh.closed_surface(f.filter("fid > 0"), ["cell_id"]).first()["closed"]
    r = mesh.sphericity_volume(v, f).first()
    area = 1.5 + math.sqrt(3) / 2
    assert abs(r.volume - 1 / 6) < 1e-12 and abs(r.area - area) < 1e-12 and abs(r.sphericity - 36 * math.pi / 36 / area**3) < 1e-12
    assert mesh.face_adjacency(v, f).count() == 12
    ball = mesh.geodesic_ball(f.select(F.col("fid").alias("seed")).limit(1), mesh.face_adjacency(v, f), 0.01)
    assert ball.count() >= 3
    moved = mesh.laplacian_smooth(v, f, 0.8, 6).agg(F.max("x") - F.min("x")).first()[0]
    assert moved < 1e-3


def test_grid_normals_paths_and_planes(spark):
    n = 6
    v = spark.createDataFrame([(y * n + x, float(x), float(y), 0.0) for y in range(n) for x in range(n)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(2 * (y * n + x) + k, *t, 0) for y in range(n - 1) for x in range(n - 1) for k, t in enumerate(((y * n + x, y * n + x + 1, y * n + n + x), (y * n + x + 1, y * n + n + x + 1, y * n + n + x)))], "fid long, v0 long, v1 long, v2 long, cell_id long")
    assert all(abs(r.nz - 1) < 1e-12 for r in mesh.vertex_normals(v, f).collect())
    normal = mesh.plane_fit(mesh.face_centroids(v, f), ["cell_id"]).first()["normal"]
    assert abs(abs(normal[2]) - 1) < 1e-9
    path = mesh.geodesic_path(spark.createDataFrame([(0, 50), (0, 9999)], "seed long, target long"), mesh.face_adjacency(v, f), 50.0).collect()
    assert len(path) == 1 and path[0].path[0] == 50 and path[0].path[-1] == 0


def test_ellipsoids_of_an_isotropic_cloud(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(400, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    df = spark.createDataFrame([(1, *map(float, q)) for q in p] + [(2, 0.0, 0.0, 0.0)], "cell_id long, x double, y double, z double")
    ball = {r.cell_id: r.lengths for r in mesh.ellipsoid_axes(df, ["cell_id"], "mvee").collect()}
    assert np.allclose(ball[1], 1, atol=0.05) and ball[2] == [1.0, 1.0, 1.0]
    pca = {r.cell_id: r.lengths for r in mesh.ellipsoid_axes(df, ["cell_id"]).collect()}
    assert pca[1][2] / pca[1][0] > 0.9 and pca[2] == [1.0, 1.0, 1.0]


def test_shape_of_a_ball_and_a_cube(spark):
    cube = block(spark, 7, lambda x, y, z: 5 if 1 <= min(x, y, z) and max(x, y, z) <= 5 else 0)
    r = labels.shape_features(cube, ["specimen"], "label").first()
    assert (r.volume, r.area) == (125.0, 150.0) and abs(r.feret - math.sqrt(48)) < 1e-9 and abs(r.elongation - 1) < 1e-6


def test_morphology_conserves_and_diffusion_needs_two_steps(spark):
    v = block(spark, 6, lambda x, y, z: int(x > 2)).withColumn("intensity", F.col("x") * 1.0)
    opened = voxels.opening(v, ["specimen"], "label").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in opened} == {0: 108, 1: 108}
    same = voxels.anisodiff(v, ["specimen"], 1)
    assert same.join(v.withColumnRenamed("intensity", "i"), ["x", "y", "z"]).filter("intensity <> i").count() == 0
    later = voxels.anisodiff(v, ["specimen"], 5, kappa=1.0)
    assert abs(later.agg(F.sum("intensity")).first()[0] - 540.0) < 1e-6


def test_filters_are_idempotent(spark):
    v = block(spark, 8, lambda x, y, z: 1 if x < 3 else 2 if x > 4 and y != 4 else 0)
    once = labels.filter_components(v, ["specimen"], "label", 0, 10**6)
    assert labels.filter_components(once, ["specimen"], "label", 0, 10**6).count() == once.count() == 3 * 64 + 3 * 4 * 8
    with pytest.raises(ValueError):
        labels.postprocess(v, ["nothing"])


def test_decay_fit_finds_parameters(spark):
    z = np.arange(0, 200, 5.0)
    rows = [(1, int(t), float(20 + 80 / (1 + math.exp(0.05 * (t - 90))))) for t in z] + [(2, 0, 1.0)]
    got = {r.specimen: r for r in cohort.decay_fit(spark.createDataFrame(rows, "specimen int, z int, foreground double"), ["specimen"]).collect()}
    assert np.allclose([got[1].a, got[1].b, got[1].c, got[1].d], [80, 0.05, 90, 20], rtol=1e-3) and got[2].a is None or math.isnan(got[2].a)
    for model, f in (("exponential", lambda t: 50 * math.exp(-0.02 * t) + 3), ("logarithmic", lambda t: 90 - 8 * math.log1p(t))):
        rows = [(1, int(t), f(t)) for t in z]
        p = cohort.decay_fit(spark.createDataFrame(rows, "specimen int, z int, foreground double"), ["specimen"], model).first()
        assert abs(p.a - f.__code__.co_consts[1]) < 0.5


def test_vote_with_equal_areas(spark):
    df = spark.createDataFrame([(1, 0, 5, [1.0, 0.0, 0.0]), (1, 1, 5, [0.0, 0.0, 1.0]), (1, 2, 5, [0.0, 0.0, 1.0])], "id long, slice int, area int, probs array<double>")
    r = voting.slice_vote(df).first()
    assert r.y_pred == 2 and abs(r.confidence - 2 / 3) < 1e-12


def test_nifti_formats(spark, tmp_path):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 200, (4, 3, 2)).astype("u1")
    (tmp_path / "a.nii").write_bytes(files.nifti_bytes(a, (0.5, 0.5, 2.0)))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(files.nifti_bytes(a.astype("f4"), (0.123456789, 1, 1))))
    got = files.read_nifti(spark, f"{tmp_path}/*.nii*", "ZYX").collect()
    assert len(got) == 48 and all(r.intensity == a[r.z, r.y, r.x] for r in got)
    meta = {r.path[-5:]: r for r in files.volume_metadata(spark, f"{tmp_path}/*.nii*").collect()}
    assert (meta["a.nii"].x_size, meta["a.nii"].z_res) == (4, 2.0) and meta["ii.gz"].x_res == 0.123457
    with pytest.raises(ValueError):
        files.nifti_header(b"no")


def test_config_grid_has_the_known_size(spark):
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "step string")
    orders = cohort.step_orders(names("bilateral", "anisodiff"))
    after3 = cohort.step_orders(names("split", "open", "close"), [("open", "close")])
    after2 = spark.createDataFrame([(i, [s]) for i, s in enumerate(["merge", "graph", "open", ""])], "place int, steps array<string>")
    table = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "v double")
    thr, prob, flow = (table(np.round(np.linspace(a, b, n), 1)) for a, b, n in ((0.2, 0.6, 6), (0, 0.4, 4), (0.2, 0.6, 4)))
    two = cohort.config_grid(orders, after2, {"thr": thr, "flow": flow}, "pipeline_2D").count()
    three = cohort.config_grid(orders, after3, {"prob": prob, "flow": flow}, "pipeline_3D").count()
    assert (orders.count(), after3.count(), two + three) == (5, 8, 1040)


def test_incremental_runs_only_what_is_missing(spark):
    folder, catalog = Workspace(spark).path("stage"), spark.createDataFrame([("a",), ("b",), ("c",)], "specimen string")
    inputs = spark.createDataFrame([("a", 1), ("b", 2)], "specimen string, v int")
    first = incremental.incremental(catalog.filter("specimen = 'a'"), inputs, folder, lambda df: df)
    assert first.count() == 1
    assert incremental.incremental(catalog, inputs, folder, lambda df: df.withColumn("v", F.col("v") * 10)).agg(F.sum("v")).first()[0] == 21
    assert incremental.todo(catalog, inputs, folder).isEmpty()


def test_component_sizes_are_tested_before_the_largest_is_taken(spark):
    """Parts of 50 and 30 voxels with 20 < n < 40: the 30 stay."""
    rows = [(0, x, 0, 0, 7) for x in range(50)] + [(0, x, 5, 0, 7) for x in range(30)] + [(0, x, 9, 0, 7) for x in range(10)]
    got = labels.filter_components(spark.createDataFrame(rows, "specimen int, x int, y int, z int, label int"), ["specimen"], "label", 20, 40).collect()
    assert {(r.x, r.y) for r in got} == {(x, 5) for x in range(30)}


def test_border_of_sparse_labels_is_that_of_the_frame(spark):
    cell = lambda at, n: [(0, x, at + y, at + z, n) for x in range(3) for y in range(3) for z in range(3)]
    df = spark.createDataFrame(cell(500, 1) + cell(0, 2) + cell(1021, 3), "specimen int, x int, y int, z int, label int")
    sizes = spark.createDataFrame([(0, 1024, 1024, 1024)], "specimen int, x_size int, y_size int, z_size int")
    assert {r.label for r in labels.border_filter(df, ["specimen"], "label", sizes=sizes).collect()} == {1}


@pytest.mark.parametrize("neighbours", [6, 18, 26])
def test_voxel_components_equal_a_plain_fill(spark, neighbours):
    rng = random.Random(neighbours)
    grid = {(x, y, z): rng.choice([0, 0, 1, 2]) for x in range(-2, 9) for y in range(7) for z in range(6)}
    df = spark.createDataFrame([(4, *p, v) for p, v in grid.items()], "specimen int, x int, y int, z int, label int")
    reach, want = {6: 1, 18: 2, 26: 3}[neighbours], {}
    for p in sorted(p for p, v in grid.items() if v):
        if p in want:
            continue
        todo = [p]
        want[p] = p
        while todo:
            q = todo.pop()
            for d in [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if 0 < abs(a) + abs(b) + abs(c) <= reach]:
                r = tuple(u + v for u, v in zip(q, d))
                if grid.get(r) == grid[p] and r not in want:
                    want[r] = p
                    todo.append(r)
    got = {(r.x, r.y, r.z): (r.component.x, r.component.y, r.component.z) for r in labels.voxel_components(df, ["specimen"], "label", neighbours).collect()}
    assert got == want


def test_opening_and_closing_of_a_block_with_a_spur_and_a_hole(spark):
    solid = {(x, y, z) for x in range(5, 14) for y in range(5, 14) for z in range(5, 14)}
    df = lambda points: spark.createDataFrame([(0, *p, 3) for p in points], "specimen int, x int, y int, z int, label int")
    sizes = spark.createDataFrame([(0, 20, 20, 20)], "specimen int, x_size int, y_size int, z_size int")
    spur = solid | {(14, 9, 9), (15, 9, 9)}
    opened = {(r.x, r.y, r.z) for r in labels.clean_opening(df(spur), ["specimen"], "label", 1, 1, sizes).collect()}
    assert (15, 9, 9) not in opened and {(9, 9, 9), (5, 9, 9)} <= opened and opened <= spur
    closed = {(r.x, r.y, r.z) for r in labels.clean_closing(df(solid - {(9, 9, 9)}), ["specimen"], "label", 1, 1, sizes).collect()}
    assert closed == solid


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(12)
    data = {1: rng.normal(size=500), 2: np.repeat([1.0, 5.0], [300, 7]), 3: np.array([4.0]), 4: rng.integers(0, 9, 400).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [(4, None), (5, None)], "k int, v double")
    shares = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.77, "e": 1.0}
    for most in (4, 50, 1 << 16):
        got = {r.k: r for r in voxels.percentiles(df, ["k"], "v", shares, most=most).collect()}
        assert set(got) == set(data)
        for k, x in data.items():
            assert np.allclose([got[k][n] for n in shares], np.quantile(x, list(shares.values())))
    assert np.allclose(voxels.percentiles(df, [], "v", {"m": 0.5}).first()["m"], np.median(np.concatenate(list(data.values()))))


def test_nearest_join_leaves_out_points_without_a_place(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 1.0, 1.0), (3, float("nan"), 0.0, 0.0), (4, 1e6, 0.0, 0.0)], "pid long, x double, y double, z double")
    tgt = spark.createDataFrame([(7, 1.0, 0.0, 0.0), (8, None, 0.0, 0.0)], "tid long, x double, y double, z double")
    assert {r.pid: r.tid for r in spatial.nearest_join(pts, tgt, 1.0).collect()} == {1: 7, 4: 7}


def test_bounded_paths_equal_dijkstra(spark):
    rng = random.Random(15)
    edges = {(a, b): rng.choice([0.5, 1.0, 2.0, 2.5]) for a in range(40) for b in rng.sample(range(40), 2) if a != b}
    edges = {k: w for (a, b), w in edges.items() for k in ((a, b), (b, a))}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, w double")
    got = {(r.seed, r.node): r.dist for r in graph.bounded_paths(spark.createDataFrame([(0,), (5,), (5,)], "seed long"), df, 6.0).collect()}
    want = {}
    for seed in (0, 5):
        dist = {seed: 0.0}
        for _ in range(40):
            for (a, b), w in edges.items():
                if a in dist and dist[a] + w < dist.get(b, 1e9):
                    dist[b] = dist[a] + w
        want |= {(seed, n): d for n, d in dist.items() if d <= 6}
    assert got == want


def test_vector_and_dirichlet_fits_reach_the_least_loss(spark):
    from tissueframe.operators import calibration

    rng = np.random.default_rng(8)
    z = rng.normal(size=(400, 3)) * 3
    p = np.exp(z * [0.4, 0.9, 0.6] + [0.3, -0.2, 0.0])
    y = [int(rng.choice(3, p=q / q.sum())) for q in p]
    df = spark.createDataFrame([(v, [float(t) for t in r]) for v, r in zip(y, z)], "y_true int, z array<double>")
    scales, bias = calibration.fit_vector(df)

    def loss(w):
        s = z * w[:3] + w[3:]
        s = s - s.max(1, keepdims=True)
        return -(s[np.arange(400), y] - np.log(np.exp(s).sum(1))).mean() + 5e-4 * (((w - [1, 1, 1, 0, 0, 0]) ** 2).sum())

    at = np.array(scales + bias)
    slope = [(loss(at + h) - loss(at - h)) / 2e-5 for h in np.eye(6) * 1e-5]
    assert np.abs(slope).max() < 1e-5 and loss(at) < loss(np.array([1, 1, 1, 0, 0, 0.0]))
    soft = np.exp(z - z.max(1, keepdims=True))
    probs = spark.createDataFrame([(v, [float(t) for t in r / r.sum()]) for v, r in zip(y, soft)], "y_true int, probs array<double>")
    alphas = calibration.fit_dirichlet(probs)
    raw = (soft / soft.sum(1, keepdims=True)) ** np.log1p(np.exp(alphas))
    got = probs.select(calibration.dirichlet(F.col("probs"), alphas).alias("q")).collect()
    assert np.allclose([r.q for r in got], raw / raw.sum(1, keepdims=True))
    assert -np.log((raw / raw.sum(1, keepdims=True))[np.arange(400), y]).mean() < -np.log((soft / soft.sum(1, keepdims=True))[np.arange(400), y]).mean()


def test_perpendicularity_equals_a_plain_version(spark):
    """Cells over a bumpy sheet: nearest face, ball by Dijkstra, plane and axis by eigenvectors."""
    rng = np.random.default_rng(21)
    n = 7
    at = np.array([(10.0 * x, 10.0 * y, float(rng.integers(0, 6))) for y in range(n) for x in range(n)])
    tris = [t for y in range(n - 1) for x in range(n - 1) for t in ((y * n + x, y * n + x + 1, y * n + n + x), (y * n + x + 1, y * n + n + x + 1, y * n + n + x))]
    cells = [k // 18 for k in range(len(tris))]
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, *t, c) for i, (t, c) in enumerate(zip(tris, cells))], "fid long, v0 long, v1 long, v2 long, cell_id long")
    got = {r.cell_id: r.angle for r in mesh.perpendicularity(v, f, v, f, 15.0, 20.0).collect()}
    centre = np.array([at[list(t)].mean(0) for t in tris])
    near = {i: [(j, np.linalg.norm(centre[i] - centre[j])) for j in range(len(tris)) if j != i and len(set(tris[i]) & set(tris[j])) == 2] for i in range(len(tris))}
    for c in set(cells):
        own = [t for t, k in zip(tris, cells) if k == c]
        middle = at[[i for t in own for i in t]].mean(0)
        seed = int(np.linalg.norm(centre - middle, axis=1).argmin())
        dist = {seed: 0.0}
        for _ in range(len(tris)):
            for i in list(dist):
                for j, w in near[i]:
                    if dist[i] + w < dist.get(j, 1e9):
                        dist[j] = dist[i] + w
        ball = [i for i, d in dist.items() if d <= 15.0]
        assert len(ball) >= 3
        normal = np.linalg.eigh(np.cov(centre[ball].T, bias=True))[1][:, 0]
        axis = np.linalg.eigh(np.cov(at[sorted({i for t in own for i in t})].T))[1][:, -1]
        angle = np.degrees(np.arccos(np.clip(axis @ normal, -1, 1)))
        assert min(abs(got[c] - angle), abs(got[c] - (180 - angle))) < 1e-4


def test_axes_of_lines_planes_and_points_equal_lapack(spark):
    """Eigenvalues that are equal or vanish: voxels on lines, in planes, single ones, and clouds far from the origin."""
    import numpy as np

    from tissueframe.operators import labels as L

    rng = np.random.default_rng(12)
    sets = [np.array([[k, 0, 0] for k in range(n)]) for n in (1, 2, 3, 9)] + [np.array([[3 * k, 2 * k, -k] for k in range(7)]), np.array([[i, j, 0] for i in range(4) for j in range(4)]), np.array([[i, j, i + j] for i in range(3) for j in range(5)])]
    sets += [np.array([[i, j, k] for i in range(3) for j in range(3) for k in range(3)]), np.array([[i, j, k] for i in range(2) for j in range(2) for k in range(9)])]
    sets += [rng.integers(0, 6, (30, 3)) + 10**5 for _ in range(10)] + [rng.integers(0, 40, (5, 3)) for _ in range(10)] + [np.array([[k, 7 * k, 10**4] for k in range(5)])]
    rows = [(i + 1, *map(int, v), 1) for i, s in enumerate(sets) for v in np.unique(s, axis=0)]
    got = {r.e: r for r in L.axis_lengths(spark.createDataFrame(rows, "e long, x long, y long, z long, lab int"), ["e"], "lab").collect()}
    for i, s in enumerate(sets):
        want = 4 * np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(np.unique(s, axis=0).T, bias=True) if len(np.unique(s, axis=0)) > 1 else np.zeros((3, 3)))[::-1], 0))
        assert np.allclose([got[i + 1].major, got[i + 1].minor, got[i + 1].least], want, atol=2e-6 * max(1, want[0])), (i, got[i + 1], want)


def test_key_columns_of_any_name(spark):
    from tissueframe.operators import labels as L
    from tissueframe.operators import voxels as V

    names = ["s", "o", "e", "n", "u", "v", "node", "_c", "_g", "component2"]
    rows = [(*[1] * len(names), x, 0, 0, 5) for x in (0, 1, 2, 7)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names) + ", x long, y long, z long, lab int")
    assert V.exposed_faces(df, names, "lab").count() == 14 + 6
    comp = L.voxel_components(df, names, "lab").groupBy("component").count().collect()
    assert sorted(r["count"] for r in comp) == [1, 3]
    assert L.axis_lengths(df, names, "lab").first().least == 0


def test_keys_that_hold_bars_or_nulls(spark):
    from tissueframe.operators import scoring

    rows = [("a|b", "c", 1, 1), ("a", "b|c", 1, 2), ("a", "b|c", 2, 2), (None, "c", 4, 4), ("x", None, 4, 5)]
    df = spark.createDataFrame([(*r, k) for r in rows for k in range(30)], "p string, q string, pred long, gt long, k long")
    overlap = scoring.label_overlap(df, ["p", "q"])
    got = {(r.p, r.q, r.side, r.label): r.state for r in scoring.segmentation_states(overlap, ["p", "q"]).collect()}
    assert got["a|b", "c", "target", 1] == "correct" and got["a|b", "c", "reference", 1] == "correct"
    assert got["a", "b|c", "target", 1] == "over_segmented"
    assert got[None, "c", "target", 4] == "correct" and got["x", None, "reference", 5] == "correct"


def test_regression_of_exact_and_constant_data(spark):
    from tissueframe.operators import cohort

    rows = [("exact", float(i), 2.0 * i) for i in range(6)] + [("tenths", i / 10, 0.3 * i / 10 + 0.1) for i in range(9)] + [("flat", float(i), 3.0) for i in range(5)] + [("one_x", 2.0, float(i)) for i in range(4)] + [("two", 0.0, 1.0), ("two", 1.0, 5.0)] + [("real", float(i), i + (-1.0) ** i) for i in range(8)]
    got = {r.g: r for r in cohort.regression(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", "x", ["g"]).collect()}
    assert set(got) == {"exact", "tenths", "flat", "one_x", "two", "real"}
    for g, slope in (("exact", 2.0), ("tenths", 0.3)):
        assert abs(got[g].slope - slope) < 1e-9 and got[g].r2 == 1 and got[g].slope_error == 0 and got[g].f is None and got[g].t is None and got[g].durbin_watson is None
    assert got["flat"].slope == 0 and got["one_x"].slope is None and got["one_x"].n == 4 and got["two"].slope_error is None
    assert got["real"].f > 0 and got["real"].durbin_watson > 2


def dijkstra(edges, seed, radius):
    import heapq

    out, heap = {}, [(0.0, seed)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in out or d > radius:
            continue
        out[x] = d
        for y, w in edges.get(x, ()):
            heapq.heappush(heap, (d + w, y))
    return out


@pytest.mark.parametrize(("symmetric", "step"), [(True, 0.7), (True, 5.0), (False, 1.3), (True, None)])
def test_buckets_of_paths_equal_dijkstra(spark, symmetric, step):
    import random

    rng, edges = random.Random(17), {}
    for _ in range(260):
        a, b, w = rng.randrange(90), rng.randrange(90), rng.choice([0.0, 0.3, 1.0, 2.5, 4.0])
        edges.setdefault(a, []).append((b, w))
        if symmetric:
            edges.setdefault(b, []).append((a, w))
    df = spark.createDataFrame([(a, b, w) for a, to in edges.items() for b, w in to], "src long, dst long, w double")
    got = {(r.seed, r.node): r.dist for r in graph.bounded_paths(spark.createDataFrame([(s,) for s in (0, 3, 3, 500)], "seed long"), df, 6.0, step=step, symmetric=symmetric).collect()}
    want = {(s, n): d for s in (0, 3, 500) for n, d in dijkstra(edges, s, 6.0).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_settled_buckets_are_left_alone(spark, monkeypatch):
    """On a long chain the rows that a round compares with stay as few, however many are settled."""
    chain = [(i, i + 1, 1.0) for i in range(40)]
    df = spark.createDataFrame(chain + [(b, a, w) for a, b, w in chain], "src long, dst long, w double")
    read, union = [], graph._all
    monkeypatch.setattr(graph, "_all", lambda tables: read.append(sum(t.count() for t in tables)) or union(tables))
    assert graph.bounded_paths(spark.createDataFrame([(0,)], "seed long"), df, 40.0, step=4.0, symmetric=True).count() == 41
    assert max(read[:-1]) <= 12 and read[-1] == 41


def test_paths_double_in_few_jobs(spark):
    from tissueframe.workspace import Workspace

    n = 200
    before = spark.createDataFrame([(0, i + 1, i) for i in range(n)] + [(7, 9, 8), (7, 8, 7)], "seed long, node long, back long")
    ends = spark.createDataFrame([(0, n), (0, 5), (0, 0), (7, 9)], "seed long, target long")
    work = Workspace(spark)
    got = {(r.seed, r.target): r.path for r in graph.paths_back(ends, before, work).collect()}
    assert got == {(0, n): list(range(n, -1, -1)), (0, 5): [5, 4, 3, 2, 1, 0], (0, 0): [0], (7, 9): [9, 8, 7]}
    assert len(work.written) < 22


def test_greedy_matching_equals_a_walk(spark):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        size = [rng.randrange(1, 9) for _ in range(60)]
        near = {(a, b) for _ in range(110) for a, b in [(rng.randrange(60), rng.randrange(60))] if a != b}
        near |= {(b, a) for a, b in near} | ({(i, i + 1) for i in range(20)} | {(i + 1, i) for i in range(20)})
        small = [a for a in range(60) if size[a] < 6]
        took, want = set(), set()
        for a in small:
            free = [b for x, b in near if x == a and b not in took]
            if a not in took and free:
                b = min(free, key=lambda b: (-size[b], b))
                took |= {a, b}
                want.add((a, b))
        df = spark.createDataFrame([(1, a, b, size[b]) for a, b in near if a in small], "g int, a long, b long, weight long")
        for few in (0, 90, 10**6):  # rounds alone, rounds and a walk, a walk alone
            assert {(r.a, r.b) for r in graph.greedy_matching(df, ["g"], few=few).collect()} == want


def test_merge_takes_components_and_each_once(spark):
    """A label with a large and a small far part loses the small one to its neighbour; numbers follow first voxels."""
    from tissueframe.operators import labels as L

    box = lambda lab, x0, y0, n, m: [("v", x, y, 0, lab) for x in range(x0, x0 + n) for y in range(y0, y0 + m)]
    rows = box(1, 0, 0, 10, 10) + box(1, 20, 0, 2, 2) + box(2, 22, 0, 5, 5) + box(3, 30, 0, 1, 3) + box(3, 33, 0, 1, 3) + box(4, 50, 0, 2, 2)
    df = spark.createDataFrame(rows, "k string, x long, y long, z long, lab int")
    got = {(r.x, r.y): r.lab for r in L.merge_small(df, ["k"], "lab", 20, 3).collect()}
    assert {got[x, y] for x in (0, 9) for y in (0, 9)} == {1}
    assert got[20, 0] == got[22, 0] == 3  # region 2 went to region 3
    assert got[30, 0] == got[33, 0] == 5  # region 4 found region 3 taken, so it took region 5
    assert got[50, 0] == 6 and len(got) == len(rows)
    ids = {(r.x, r.y): r.lab for r in L.split_components(df, ["k"], "lab", 4).collect()}
    assert ids[0, 0] == 1 and ids[20, 0] == 2 and ids[22, 0] == 3 and (30, 0) not in ids and ids[50, 0] == 4
    assert L.split_components(df, ["k"], "lab").count() == 0  # fewer than 500 voxels each


def test_percentiles_of_outliers_and_ties(spark):
    """One value of 1e12 beside many small ones, and a third of all values at one place: few values are ranked."""
    rng = np.random.default_rng(31)
    x = np.concatenate([rng.normal(size=6000), np.full(3000, 0.25), [1e12, -1e15]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    shares = {"a": 0.001, "b": 0.3, "c": 0.61, "d": 0.999}
    got = voxels.percentiles(df, [], "v", shares, most=200).first()
    assert np.allclose([got[n] for n in shares], np.quantile(x, list(shares.values())), rtol=1e-12)


def test_auc_of_saturated_scores(spark):
    from tissueframe.operators import calibration

    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 400), np.clip(rng.normal(0.999, 0.002, 400), 0, 1)
    p = np.clip(p + 0.001 * y, 0, 1)
    rows = [([float(1 - b), float(b)], int(a)) for a, b in zip(y, p)]
    got = {r["class"]: r.auc for r in calibration.multilabel_auc(spark.createDataFrame(rows, "probs array<double>, y_true int"), [], 2).collect()}
    want = np.mean([(b > c) + 0.5 * (b == c) for b in p[y == 1] for c in p[y == 0]])
    assert abs(got[1] - want) < 1e-9


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_balls_equal_plain_loops(spark, radius):
    """Sparse labels and a table with holes, against all offsets of the ball; rows aren't multiplied."""
    rng = np.random.default_rng(radius)
    n, ball = 9, [(a, b, c) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) for c in range(-radius, radius + 1) if a * a + b * b + c * c <= radius * radius]
    lab = rng.integers(0, 5, (n, n, n)) * (rng.random((n, n, n)) < 0.97)
    lab[:, :5] = np.maximum(lab[:, :5], 1)
    full = {(x, y, z): int(lab[x, y, z]) for x in range(n) for y in range(n) for z in range(n)}
    some = {k: v for k, v in full.items() if rng.random() < 0.9}
    df = spark.createDataFrame([(1, *k, v) for k, v in some.items()], "k int, x long, y long, z long, lab long")
    near = lambda d, k: [d[q] for a, b, c in ball if (q := (k[0] + a, k[1] + b, k[2] + c)) in d]
    for fn, pick in ((voxels.dilate_ball, max), (voxels.erode_ball, min)):
        got = {(r.x, r.y, r.z): r.lab for r in fn(df, ["k"], "lab", radius).collect()}
        assert got == {k: pick(near(some, k)) for k in some}
    dense = spark.createDataFrame([(1, *k, v) for k, v in full.items() if v], "k int, x int, y int, z int, lab long")
    size = spark.createDataFrame([(1, n, n, n)], "k int, x_size int, y_size int, z_size int")
    grown = {(r.x, r.y, r.z): r.lab for r in labels.grow(dense, ["k"], "lab", radius, size).collect()}
    assert grown == {k: v for k in full if (v := max(near(full, k)))}
    shrunk = {(r.x, r.y, r.z): r.lab for r in labels.shrink(dense, ["k"], "lab", radius, size).collect()}
    assert shrunk == {k: v for k in full if (v := min(near(full, k)))}


def test_far_points_meet_few_leaves(spark, monkeypatch):
    """Points far off a dense cloud: exact, with ties by the lower target, and most leaves are never met."""
    rng = np.random.default_rng(41)
    t = np.concatenate([rng.normal(size=(3000, 3)), rng.normal(size=(300, 3)) + [500, 0, 0], [[0, 0, -60], [0, 0, -60]]])
    p = np.concatenate([rng.normal(size=(40, 3)) * 300, rng.normal(size=(10, 3)), [[0, 0, -90], [-7.5, 0.1, 2000]]])
    pts = spark.createDataFrame([(g, i, *map(float, v)) for g in (1, 2) for i, v in enumerate(p)], "g int, pid long, x double, y double, z double")
    tgt = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(t)] + [(2, 5, 1.0, 1.0, 1.0), (3, 6, 0.0, 0.0, 0.0)], "g int, tid long, x double, y double, z double")
    got = {(r.g, r.pid): (r.tid, r.dist) for r in spatial.nearest_join(pts, tgt, 0.5, ["g"]).collect()}
    d = np.sqrt(((p[:, None] - t[None]) ** 2).sum(2))
    assert len(got) == 2 * len(p)
    for i in range(len(p)):
        assert got[1, i][0] == int(d[i].argmin()) and abs(got[1, i][1] - d[i].min()) < 1e-9 and got[2, i][0] == 5


def test_decay_fits_tell_whether_they_rest(spark):
    """Infinite and missing slices don't count; a volume without finite ones has no fit."""
    z = range(0, 100, 5)
    rows = [(1, t, 50 * math.exp(-0.02 * t) + 3) for t in z] + [(1, 7, math.inf), (1, 8, -math.inf), (1, 9, math.nan), (1, 11, None)] + [(2, t, math.inf) for t in z]
    df = spark.createDataFrame(rows, "specimen int, z int, foreground double")
    got = {r.specimen: r for r in cohort.decay_fit(df, ["specimen"], "exponential").collect()}
    assert np.allclose([got[1].a, got[1].b, got[1].c], [50, 0.02, 3], rtol=1e-3) and got[1].converged is True and got[2].converged is None
    cut = {r.specimen: r for r in cohort.decay_fit(df, ["specimen"], "exponential", rounds=1).collect()}
    assert cut[1].converged is False and abs(cut[1].b - 0.02) < 1e-2 and cut[2].converged is None


#: Each model as a plain function, and parameters that a noisy profile is made of.
CURVES = {
    "logistic": (lambda z, a, b, c, d: d + a / (1 + np.exp(np.clip(b * (z - c), -500, 500))), (80, 0.05, 90, 20)),
    "exponential": (lambda z, a, b, c: a * np.exp(-b * z) + c, (50, 0.02, 3)),
    "logarithmic": (lambda z, a, b: a + b * np.log1p(z), (90, -8)),
    "gompertz": (lambda z, a, b, c: a * np.exp(-b * np.exp(c * z)), (120, 0.1, 0.02)),
    "biexponential": (lambda z, a, b, c, d: a * np.exp(-b * z) + c * np.exp(-d * z), (60, 0.004, 40, 0.08)),
}


def plain_fit(f, z, y, p, rounds=400):
    """Damped Gauss-Newton steps from the true parameters."""
    p, damp = np.array(p, float), 1e-2
    for _ in range(rounds):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        j = np.stack([(f(z, *(p + h * (np.arange(len(p)) == i))) - f(z, *p)) / h[i] for i in range(len(p))], 1)
        a, e = j.T @ j, y - f(z, *p)
        new = p + np.linalg.lstsq(a + damp * np.diag(np.diag(a)), j.T @ e, rcond=None)[0]
        p, damp = (new, damp / 3) if ((y - f(z, *new)) ** 2).sum() < (e**2).sum() else (p, damp * 4)
    return p


@pytest.mark.parametrize("model", CURVES)
def test_decay_fits_have_the_least_error(spark, model):
    """Profiles of two volumes, one of them shifted in depth, against plain Gauss-Newton steps; a volume of one depth and
    one with a flat profile beside them; the names of the key clash with none of the operator's."""
    f, truth = CURVES[model]
    rng, rows = np.random.default_rng(8), []
    for volume, start in (("p", 0), ("o", 20)):
        z = np.arange(start, start + 240, 4.0)
        rows += [(volume, float(t), float(v)) for t, v in zip(z, f(z, *truth) + rng.normal(0, 0.2, len(z)))]
    rows += [("same", 3.0, float(v)) for v in range(9)] + [("flat", float(t), 7.0) for t in range(9)]
    df = spark.createDataFrame(rows, "n string, z double, foreground double").repartition(3)
    got = {r.n: r for r in cohort.decay_fit(df, ["n"], model).collect()}
    assert set(got) == {"p", "o", "same", "flat"} and got["same"].a is None and got["same"].converged is None
    for volume in "po":
        z, y = (np.array([r[k] for r in rows if r[0] == volume]) for k in (1, 2))
        p = [got[volume][c] for c in "abcd"[: len(truth)]]
        best = plain_fit(f, z, y, truth)
        assert got[volume].converged and np.allclose(p, best, rtol=1e-4), (model, p, best)
        assert ((y - f(z, *p)) ** 2).sum() <= ((y - f(z, *best)) ** 2).sum() * (1 + 1e-6)
    flat = cohort.decay_fit(df.limit(0), ["n"], model)
    assert flat.count() == 0 and flat.columns == ["n", *"abcd"[: len(truth)], "converged"]


def test_calibration_fits_warn_when_cut_off(spark):
    from tissueframe.operators import calibration

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([([float(v) for v in rng.normal(size=3)], int(rng.integers(3))) for _ in range(80)], "z array<double>, y_true int")
    with pytest.warns(RuntimeWarning):
        calibration.fit_vector(df, rounds=1)


class Watched(Workspace):
    """Keeps the plans of what is written."""

    def __init__(self, spark):
        super().__init__(spark)
        self.plans = []

    def write(self, df, **options):
        self.plans.append(df._jdf.queryExecution().executedPlan().toString())
        return super().write(df, **options)


@pytest.fixture
def small_files(spark):
    """Written tables, whose files hold a few kB, are below the size that Spark sends to all, and what joins make is above."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("step, share, left", [(labels.remove_small, 80, 176), (labels.remove_large, 20, 336)])
def test_components_of_many_runs_are_not_sent_to_the_driver(spark, small_files, monkeypatch, step, share, left):
    """However well the files of runs and edges are compressed, their rows meet by key."""
    monkeypatch.setattr("tissueframe.workspace.MANY_ROWS", 0, raising=False)
    work = Watched(spark)
    v = work.write(block(spark, 8, lambda x, y, z: 1 + (x // 2 + y // 3 + z // 4) % 3))
    got = step(v, ["specimen"], "label", share, work=work)
    assert len(work.plans) > 3 and not any("BroadcastExchange" in p for p in work.plans[1:])
    assert got.count() == left


@pytest.mark.parametrize("step, options", [("split", {"least": 3}), ("merge_connected_components", {"least": 12, "radius": 2}), ("merge_graph", {"distance": 2.0}), ("remove_small_objects", {})])
def test_steps_on_written_labels_meet_by_key(spark, small_files, monkeypatch, step, options):
    """A step of post-processing reads the table that the last one wrote; only sums over ranges are sent to all."""
    monkeypatch.setattr("tissueframe.workspace.MANY_ROWS", 0, raising=False)
    work = Watched(spark)
    v = work.write(block(spark, 8, lambda x, y, z: 1 + (x * 7 + y * 3 + z) % 11 // 4))
    got = labels.postprocess(v, [(step, options)], by=["specimen"], label="label", work=work)
    joins = [line for p in work.plans for line in p.split("\n") if "BroadcastHashJoin" in line]
    assert [j for j in joins if "__part" not in j] == [] and got.count() > 0


def test_resampling_works_on_voxels_not_frames(spark):
    """Two far slices of a frame of two billion places; every scale gives what the grid gives, voxel by voxel."""
    far = spark.createDataFrame([(0, x, y, z, x + y) for x in range(4) for y in range(3) for z in (0, 199_999_999)], "s int, x int, y int, z long, v int")
    got = voxels.resample_nearest(far, ["s"], {"x": 0.5, "y": 2.0}, "v").collect()
    assert len(got) == 2 * 6 * 2 and {r.z for r in got} == {0, 199_999_999}
    rng = np.random.default_rng(5)
    for scale in (0.3, 0.5, 0.74, 1.0, 1.37, 2.0, 3.1):
        some = {(0, int(x), int(y), int(z)): int(v) for x, y, z, v in zip(rng.integers(0, 7, 60), rng.integers(0, 5, 60), rng.integers(0, 9, 60), rng.integers(0, 99, 60))}
        df = spark.createDataFrame([(*k, v) for k, v in some.items()], "s int, x int, y int, z int, v int")
        n = [1 + max(k[i] for k in some) for i in (1, 2, 3)]
        m = [max(round(c * scale), 1) for c in n]
        axis = [[min(math.floor((t + 0.5) * n[i] / m[i]), n[i] - 1) for t in range(m[i])] for i in range(3)]
        want = {(x, y, z, some[0, a, b, c]) for x, a in enumerate(axis[0]) for y, b in enumerate(axis[1]) for z, c in enumerate(axis[2]) if (0, a, b, c) in some}
        found = [(r.x, r.y, r.z, r.v) for r in voxels.resample_nearest(df, ["s"], dict.fromkeys("xyz", scale), "v").collect()]
        assert len(found) == len(set(found)) and set(found) == want, scale


def test_candidates_of_decays_are_not_sent_to_the_driver(spark, small_files):
    """A round has thousands of candidates a volume, though its table has a row a volume."""
    work = Watched(spark)
    rows = [(s, z, 10 * s + 100 / (1 + math.exp(0.5 * (z - 9 - s)))) for s in (1, 2) for z in range(20)]
    got = cohort.decay_fit(spark.createDataFrame(rows, "specimen int, z int, foreground double"), ["specimen"], work=work)
    assert len(work.plans) > 3 and not any("BroadcastExchange" in p for p in work.plans)
    assert all(r.converged and abs(r.a - 100) < 0.01 and abs(r.c - 9 - r.specimen) < 0.01 for r in got.collect())


def test_neighborhood_sizes_in_parts_leave_little_on_disk(spark, tmp_path):
    """Parts give what all pairs give, and their tables are gone afterwards."""
    from pathlib import Path

    from tissueframe.operators import atlas

    n = 8
    v = spark.createDataFrame([(x + n * y, float(x), float(y), 0.1 * (x * y % 3)) for x in range(n) for y in range(n)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(2 * (x + n * y) + k, *(a + x + n * y for a in c), 0) for x in range(n - 1) for y in range(n - 1) for k, c in enumerate(((0, 1, n), (1, n + 1, n)))], "fid long, v0 long, v1 long, v2 long, cell_id int")
    near = atlas.face_neighborhoods(v, f, 2.0)
    want = {r.face: (r.n, r.d) for r in near.groupBy("face").agg(F.count("*").alias("n"), F.avg("dist").alias("d")).collect()}
    work = Workspace(spark)
    root = Path(work.base.removeprefix("file://")).parent
    before = set(root.iterdir())
    got = {r.face: (r.n, r.dist) for r in atlas.neighborhood_sizes(v, f, 2.0, work, most=30).collect()}
    assert len(got) == f.count() and {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    parts = [p for p in root.iterdir() if p not in before and p != Path(work.base.removeprefix("file://"))]
    assert len(parts) == 4 and not [x for p in parts for x in p.rglob("*.parquet")]
