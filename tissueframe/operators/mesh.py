"""Triangle meshes: ``vertices(vid, x, y, z)`` and ``faces(fid, v0, v1, v2, cell_id)``; ``by`` tells meshes apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.linalg import eigenvalues, eigenvector
from ..workspace import Workspace, ship
from .graph import bounded_paths, paths_back
from .spatial import XYZ, nearest_join


def corners(faces: DataFrame, by: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per corner of a face, in order."""
    return faces.select(*(by or []), "fid", *keep, F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid"))


def face_points(vertices: DataFrame, faces: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Faces with their corners' coordinates ``p``, an array of three (x, y, z)."""
    by = by or []
    rows = corners(faces, by, ("cell_id",)).join(vertices.select(*by, "vid", *XYZ), [*by, "vid"])
    return rows.groupBy(*by, "fid", "cell_id").agg(F.sort_array(F.collect_list(F.struct("corner", *XYZ))).alias("p"))


def face_centroids(vertices: DataFrame, faces: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    rows = corners(faces, by, ("cell_id",)).join(vertices.select(*by, "vid", *XYZ), [*by, "vid"])
    return rows.groupBy(*by, "fid", "cell_id").agg(*[F.avg(a).alias(a) for a in XYZ])


def cell_centroids(vertices: DataFrame, faces: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over the corners of a cell's faces: vertices weigh as often as they are used."""
    by = by or []
    rows = corners(faces, by, ("cell_id",)).join(vertices.select(*by, "vid", *XYZ), [*by, "vid"])
    return rows.groupBy(*by, "cell_id").agg(*[F.avg(a).alias(a) for a in XYZ])


def edges(faces: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The three sides of each face, lower vertex first."""
    pair = lambda i, j: F.struct(F.least(f"v{i}", f"v{j}").alias("a"), F.greatest(f"v{i}", f"v{j}").alias("b"))
    return faces.select(*(by or []), "fid", F.explode(F.array(pair(0, 1), pair(1, 2), pair(0, 2))).alias("e")).select(*(by or []), "fid", "e.a", "e.b")


def edge_to_face(faces: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first face of each edge."""
    return edges(faces, by).groupBy(*(by or []), "a", "b").agg(F.min("fid").alias("fid"))


def face_adjacency(vertices: DataFrame, faces: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``src, dst, w``: faces that share an edge, both directions, weighted by the distance of their centroids."""
    by = by or []
    e = edges(faces, by)
    pairs = e.join(e.withColumnRenamed("fid", "dst"), [*by, "a", "b"]).filter("fid <> dst").select(*by, F.col("fid").alias("src"), "dst").distinct()
    c = face_centroids(vertices, faces, by)
    a = c.select(*by, F.col("fid").alias("src"), *[F.col(x).alias(f"a{x}") for x in XYZ])
    b = c.select(*by, F.col("fid").alias("dst"), *[F.col(x).alias(f"b{x}") for x in XYZ])
    w = F.sqrt(sum((F.col(f"a{x}") - F.col(f"b{x}")) * (F.col(f"a{x}") - F.col(f"b{x}")) for x in XYZ))
    return pairs.join(a, [*by, "src"]).join(b, [*by, "dst"]).select(*by, "src", "dst", w.alias("w"))


def vertex_neighbors(faces: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    e = edges(faces, by)
    return e.select(*by, F.col("a").alias("vid"), F.col("b").alias("neighbor")).unionByName(e.select(*by, F.col("b").alias("vid"), F.col("a").alias("neighbor"))).distinct()


def geodesic_ball(seeds: DataFrame, adjacency: DataFrame, radius: float, least: int = 3, tries: int = 26, work: Workspace | None = None) -> DataFrame:
    """Faces within ``radius`` of each seed along the mesh; where they are fewer than ``least`` the radius grows by 1, up to
    ``tries`` times, for those seeds alone: they are searched once more, up to the widest radius."""
    work = work or Workspace(seeds.sparkSession)
    ball = work.write(bounded_paths(seeds, adjacency, radius, work, symmetric=True))
    few = work.write(ball.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") < least).select("seed"))
    if few.isEmpty():
        return ball
    wide = work.write(bounded_paths(few, adjacency, radius + tries, work, symmetric=True))
    # The radius at which the seed has enough faces: that of the face in that place, in whole steps.
    nth = F.get(F.sort_array(F.collect_list("dist")), least - 1)
    need = wide.groupBy("seed").agg(F.when(F.count("*") >= least, radius + F.greatest(F.ceil(nth - radius), F.lit(0))).otherwise(radius + tries).alias("_r"))
    wider = wide.join(need, "seed").filter("dist <= _r").drop("_r")
    return ball.join(few, "seed", "left_anti").unionByName(wider)


def geodesic_path(seeds: DataFrame, adjacency: DataFrame, radius: float, work: Workspace | None = None) -> DataFrame:
    """For ``seeds(seed, target)``: the distance along the mesh, within ``radius``, and the faces on a shortest path from
    the target back to the seed; seeds that can't reach their target don't occur.

    Of a face's neighbours whose distance and edge add up to its own, the lowest is the one before it. Paths are put
    together from these by doubling, so a path of a thousand faces takes some twenty jobs.
    """
    work = work or Workspace(seeds.sparkSession)
    adjacency = work.write(adjacency)
    dist = work.write(bounded_paths(seeds.select("seed").distinct(), adjacency, radius, work, symmetric=True))
    ends = work.write(seeds.join(dist, (seeds.seed == dist.seed) & (seeds.target == dist.node)).select(seeds.seed, "target", "dist"))
    edge = dist.filter("node <> seed").join(adjacency.select(F.col("dst").alias("node"), F.col("src").alias("back"), "w"), "node")
    step = edge.join(dist.select("seed", F.col("node").alias("back"), F.col("dist").alias("bdist")), ["seed", "back"]).filter("abs(bdist + w - dist) < 1e-9 AND (w > 0 OR back < node)")
    before = step.groupBy("seed", "node").agg(F.min("back").alias("back"))
    return ends.join(paths_back(ends, before, work), ["seed", "target"]).select("seed", "target", "dist", "path")


def _moments(df: DataFrame, key: list[str], cov=F.covar_pop) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    return df.groupBy(*key).agg(F.count("*").alias("n"), *[cov(a, b).alias(a + b) for a, b in pairs])


_SIX = [a + b for i, a in enumerate(XYZ) for b in XYZ[i:]]


def plane_fit(points: DataFrame, key: list[str]) -> DataFrame:
    """The normal of least variance of each group of points; the z axis for fewer than three."""
    m = _moments(points, key)
    six = [F.col(c) for c in _SIX]
    normal = eigenvector(eigenvalues(*six)[2], *six)
    return m.select(*key, F.when(F.col("n") < 3, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(normal).alias("normal"))


def ellipsoid_axes(points: DataFrame, key: list[str], method: str = "pca", tolerance: float = 1e-4) -> DataFrame:
    """The half axes ``lengths``, longest first, and the direction ``axis`` of the longest; a unit sphere for fewer than
    four points. ``pca`` takes the covariance, ``mvee`` the ellipsoid of least volume around a cell's points."""
    if method == "pca":
        m = _moments(points, key, F.covar_samp)
        six = [F.col(c) for c in _SIX]
        e = eigenvalues(*six)
        sphere = F.array(*[F.lit(1.0)] * 3)
        return m.select(*key, F.when(F.col("n") < 4, sphere).otherwise(F.transform(e, lambda v: F.sqrt(F.greatest(v, F.lit(0.0))))).alias("lengths"), F.when(F.col("n") < 4, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(eigenvector(e[0], *six)).alias("axis"))

    def least(group: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(group[list(XYZ)].to_numpy(float), axis=0)
        lengths, axis = [1.0, 1.0, 1.0], [1.0, 0.0, 0.0]
        if len(p) >= 4 and np.linalg.matrix_rank(p - p.mean(0)) == 3:
            q, u, gap = np.vstack([p.T, np.ones(len(p))]), np.full(len(p), 1 / len(p)), 1.0
            while gap > tolerance:
                far = np.einsum("ij,ji->i", q.T @ np.linalg.inv(q * u @ q.T), q)
                j = int(far.argmax())
                step = (far[j] - 4) / (4 * (far[j] - 1))
                new = (1 - step) * u
                new[j] += step
                gap, u = float(np.linalg.norm(new - u)), new
            c = p.T @ u
            _, s, v = np.linalg.svd(np.linalg.inv((p.T * u @ p - np.outer(c, c)) * 3))
            lengths, axis = (1 / np.sqrt(s))[::-1].tolist(), v[-1].tolist()
        return pd.DataFrame([[*group[key].iloc[0], lengths, axis]], columns=[*key, "lengths", "axis"])

    fields = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in key)
    ship(points.sparkSession)
    return points.select(*key, *XYZ).groupBy(*key).applyInPandas(least, f"{fields}, lengths array<double>, axis array<double>")


def perpendicularity(vertices: DataFrame, faces: DataFrame, tissue_vertices: DataFrame, tissue_faces: DataFrame, radius: float, bucket: float, sigma: float = 30.0, work: Workspace | None = None) -> DataFrame:
    """For each cell: the angle between its longest axis and the normal of the tissue around its nearest face, as a score."""
    work = work or Workspace(faces.sparkSession)
    cells = cell_centroids(vertices, faces).withColumnRenamed("cell_id", "pid")
    target = face_centroids(tissue_vertices, tissue_faces).withColumnRenamed("fid", "tid")
    near = work.write(nearest_join(cells, target.select("tid", *XYZ), bucket, work=work))
    ball = geodesic_ball(near.select(F.col("tid").alias("seed")).distinct(), work.write(face_adjacency(tissue_vertices, tissue_faces)), radius, work=work)
    around = ball.join(target.withColumnRenamed("tid", "node"), "node")
    normals = plane_fit(around, ["seed"]).withColumnRenamed("seed", "tid")
    points = corners(faces, keep=("cell_id",)).join(vertices, "vid").select("cell_id", *XYZ).distinct()
    axes = ellipsoid_axes(points, ["cell_id"])
    both = near.select(F.col("pid").alias("cell_id"), "tid").join(normals, "tid").join(axes, "cell_id")
    angle = C.vector_angle([F.col("axis")[i] for i in range(3)], [F.col("normal")[i] for i in range(3)])
    return both.select("cell_id", angle.alias("angle"), C.perpendicularity(angle, sigma).alias("perpendicularity"))


def sphericity_cov(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The ratio of the least to the greatest eigenvalue of the covariance of each cell's vertices."""
    points = corners(faces, keep=("cell_id",)).join(vertices, "vid").select("cell_id", "vid", *XYZ).distinct()
    m = _moments(points, ["cell_id"], F.covar_samp)
    e = eigenvalues(*[F.col(c) for c in _SIX])
    return m.select("cell_id", F.when(e[0] > 0, F.greatest(e[2], F.lit(0.0)) / e[0]).alias("sphericity"))


def sphericity_volume(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """36 pi V^2 / A^3 of each cell's surface, with its volume by signed tetrahedra and its area."""
    p = face_points(vertices, faces)
    g = lambda i, a: F.col("p")[i][a]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    at = [[g(i, a) for a in XYZ] for i in range(3)]
    n = cross([b - a for a, b in zip(at[0], at[1])], [b - a for a, b in zip(at[0], at[2])])
    area = F.sqrt(sum(x * x for x in n)) / 2
    volume = sum(x * y for x, y in zip(at[0], cross(at[1], at[2]))) / 6
    out = p.groupBy("cell_id").agg(F.abs(F.sum(volume)).alias("volume"), F.sum(area).alias("area"))
    return out.withColumn("sphericity", F.expr("36 * pi() * volume * volume / (area * area * area)"))


def mesh_features(vertices: DataFrame, faces: DataFrame, tissue_vertices: DataFrame, tissue_faces: DataFrame, radius: float, bucket: float) -> DataFrame:
    """A row for each cell: perpendicularity, sphericity and both columnarities; null where one can't be had."""
    cells = faces.select("cell_id").distinct()
    out = cells.join(perpendicularity(vertices, faces, tissue_vertices, tissue_faces, radius, bucket), "cell_id", "left").join(sphericity_cov(vertices, faces), "cell_id", "left")
    return out.withColumns({"columnarity": C.columnarity(F.col("sphericity"), F.col("perpendicularity")), "columnarity_parallel": C.columnarity_parallel(F.col("sphericity"), F.col("perpendicularity"))})


def mesh_concat(vertices: DataFrame, faces: DataFrame, mesh: str = "mesh_id") -> tuple[DataFrame, DataFrame]:
    """Several meshes with dense vertex numbers (vid 0, 1, ... in each) as one: numbers go on after those of the meshes
    before. The running sum is over one row per mesh."""
    sizes = vertices.groupBy(mesh).agg(F.count("*").alias("n"))
    start = sizes.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy(mesh).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    v = vertices.join(start, mesh).withColumn("vid", F.col("vid") + F.col("start")).drop("start")
    f = faces.join(start, mesh).withColumns({c: F.col(c) + F.col("start") for c in ("v0", "v1", "v2")}).drop("start")
    return v, f


def submesh(vertices: DataFrame, faces: DataFrame, keep: DataFrame, by: list[str], work: Workspace | None = None, span: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """The faces of kept cells (``keep(by, cell_id)``) and their vertices, numbered densely from 0 within each mesh.
    Numbers are made in two levels: counts of the vertices used by ranges of ``span`` ids, whose running sum covers a row
    a range, and a window inside each range, so no task numbers a whole mesh."""
    work = work or Workspace(faces.sparkSession)
    some = faces.join(keep, [*by, "cell_id"], "left_semi")
    used = work.write(corners(some, by).select(*by, "vid").distinct().withColumn("_r", F.floor(F.col("vid") / span)))
    counts = used.groupBy(*by, "_r").agg(F.count("*").alias("_c"))
    start = counts.withColumn("_s", F.sum("_c").over(W.partitionBy(*by).orderBy("_r")) - F.col("_c")).drop("_c")
    number = used.join(start, [*by, "_r"]).withColumn("new", (F.col("_s") + F.row_number().over(W.partitionBy(*by, "_r").orderBy("vid")) - 1).cast("long")).select(*by, "vid", "new")
    v = vertices.join(number, [*by, "vid"]).drop("vid").withColumnRenamed("new", "vid")
    f = some
    for c in ("v0", "v1", "v2"):
        f = f.join(number.withColumnRenamed("vid", c).withColumnRenamed("new", f"_{c}"), [*by, c]).drop(c).withColumnRenamed(f"_{c}", c)
    return v, f


def closed_surface(faces: DataFrame, by: list[str]) -> DataFrame:
    """Whether every edge of a mesh lies in exactly two faces."""
    n = edges(faces, by).groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.bool_and(F.col("n") == 2).alias("closed"))


def laplacian_smooth(vertices: DataFrame, faces: DataFrame, weight: float = 0.8, rounds: int = 40, work: Workspace | None = None, every: int = 5) -> DataFrame:
    """Moves vertices towards the mean of their neighbours; every fifth round is a written table."""
    work = work or Workspace(vertices.sparkSession)
    near = work.write(vertex_neighbors(faces))
    v = vertices.select("vid", *XYZ)
    for k in range(1, rounds + 1):
        m = near.join(v.select(F.col("vid").alias("neighbor"), *XYZ), "neighbor").groupBy("vid").agg(*[F.avg(a).alias(f"_{a}") for a in XYZ])
        v = v.join(m, "vid", "left").select("vid", *[(F.col(a) + weight * (F.coalesce(f"_{a}", a) - F.col(a))).alias(a) for a in XYZ])
        if k % every == 0:
            v = work.write(v)
    return v


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Sums of the cross products of a vertex's faces, at unit length."""
    g = lambda i, a: F.col("p")[i][a]
    u, v = ([g(i, a) - g(0, a) for a in XYZ] for i in (1, 2))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    rows = face_points(vertices, faces).select("fid", *[c.alias(f"n{a}") for c, a in zip(n, XYZ)])
    total = corners(faces).join(rows, "fid").groupBy("vid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in XYZ])
    size = F.sqrt(sum(F.col(f"n{a}") * F.col(f"n{a}") for a in XYZ))
    return total.select("vid", *[(F.col(f"n{a}") / size).alias(f"n{a}") for a in XYZ])


def mesh_sizes(faces: DataFrame, by: str, pairs: DataFrame) -> DataFrame:
    """``pairs(left, right)`` of meshes with their numbers of faces, 0 for one without any, and which is coarser."""
    n = faces.groupBy(by).agg(F.count("*").alias("n"))
    out = pairs
    for side in ("left", "right"):
        out = out.join(n.select(F.col(by).alias(side), F.col("n").alias(f"n_{side}")), side, "left").fillna(0, [f"n_{side}"])
    coarser = F.when(F.col("n_left") < F.col("n_right"), "left").when(F.col("n_left") > F.col("n_right"), "right").otherwise("same")
    return out.withColumn("coarser", coarser)


def planar_uv(vertices: DataFrame, by: list[str]) -> DataFrame:
    """x and y of each mesh scaled to 0 ... 1; a range of zero counts as 1."""
    ends = vertices.groupBy(*by).agg(*[f(a).alias(f"_{n}{a}") for a in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda a: (F.col(a) - F.col(f"_lo{a}")) / F.when(F.col(f"_hi{a}") > F.col(f"_lo{a}"), F.col(f"_hi{a}") - F.col(f"_lo{a}")).otherwise(1.0)
    return vertices.join(ends, by).select(*by, "vid", scaled("x").alias("u"), scaled("y").alias("v"))
