"""Feature maps on tissue surfaces and atlases, all specimens in one job told apart by a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace, dropped_shuffles
from . import mesh as M
from .graph import bounded_paths, laid_by_source
from .spatial import XYZ, nearest_join
from .voxels import percentiles


def snap_landmarks(landmarks: DataFrame, vertices: DataFrame, names: DataFrame, bucket: float, work: Workspace | None = None) -> DataFrame:
    """The nearest vertex of each landmark that ``names(name, ord)`` lists, in that order."""
    known = landmarks.join(names, "name")
    near = nearest_join(known.select(F.col("name").alias("pid"), *XYZ), vertices.select(F.col("vid").alias("tid"), *XYZ), bucket, work=work)
    return near.withColumnRenamed("pid", "name").join(names, "name").select("name", "ord", F.col("tid").alias("vid"), "dist")


def cell_map(vertices: DataFrame, faces: DataFrame, cells: DataFrame, features: DataFrame, bucket: float, work: Workspace | None = None) -> DataFrame:
    """The nearest cell (``cells(cell_id, x, y, z)``) with features of every face: ``fid, cell_id, dist``."""
    some = cells.join(features.select("cell_id"), "cell_id", "left_semi")
    centre = M.face_centroids(vertices, faces).select(F.col("fid").alias("pid"), *XYZ)
    near = nearest_join(centre, some.select(F.col("cell_id").alias("tid"), *XYZ), bucket, work=work)
    return near.select(F.col("pid").alias("fid"), F.col("tid").alias("cell_id"), "dist")


def face_neighborhoods(vertices: DataFrame, faces: DataFrame, radius: float, work: Workspace | None = None) -> DataFrame:
    """``face, neighbor, dist`` for all faces at most ``radius`` along the mesh, itself included."""
    work = work or Workspace(faces.sparkSession)
    near = bounded_paths(faces.select(F.col("fid").alias("seed")), work.write(M.face_adjacency(vertices, faces)), radius, work, symmetric=True)
    return near.select(F.col("seed").alias("face"), F.col("node").alias("neighbor"), "dist")


#: Faces whose neighbourhoods are on disk at once; some 5 kB each at a radius that holds a hundred.
FACES_AT_ONCE = 1_000_000


def neighborhood_sizes(vertices: DataFrame, faces: DataFrame, radius: float, work: Workspace | None = None, most: int = FACES_AT_ONCE) -> DataFrame:
    """``face, n, dist``: the number of faces at most ``radius`` along the mesh, itself included, and their mean distance.
    Faces are searched from in parts of about ``most``; a part leaves a row a face, and its tables are deleted before the
    next one, so that disk follows a part and not all pairs."""
    work = work or Workspace(faces.sparkSession)
    edges = work.write(M.face_adjacency(vertices, faces))
    seeds, laid, out = work.write(faces.select(F.col("fid").alias("seed"))), laid_by_source(edges, work), None
    parts = max(1, -(-seeds.count() // most))
    for k in range(parts):
        own = Workspace(faces.sparkSession)
        near = bounded_paths(seeds.filter(F.pmod(F.xxhash64("seed"), F.lit(parts)) == k), edges, radius, own, symmetric=True, laid=laid)
        with dropped_shuffles(faces.sparkSession):
            done = work.write(near.groupBy(F.col("seed").alias("face")).agg(F.count("*").alias("n"), F.avg("dist").alias("dist")))
        own.drop(*[table for table, _ in own.written])
        out = done if out is None else out.unionByName(done)
    return out


def surface_feature_map(cells: DataFrame, neighborhoods: DataFrame, features: DataFrame, feature: str, by: list[str]) -> DataFrame:
    """The value of each face's cell, then the mean over its neighbourhood without missing ones; a face without any keeps
    its own. ``cells(by, fid, cell_id)``."""
    own = cells.join(features.select(*by, "cell_id", F.col(feature).alias("own")), [*by, "cell_id"], "left").select(*by, "fid", "own")
    around = neighborhoods.join(own.select(*by, F.col("fid").alias("neighbor"), F.col("own").alias("v")), "neighbor")
    mean = around.groupBy(*by, F.col("face").alias("fid")).agg(F.avg("v").alias("m"))
    return own.join(mean, [*by, "fid"], "left").select(*by, "fid", F.coalesce("m", "own").alias("value"))


def _fill(values: DataFrame, neighbors: DataFrame, by: list[str], default: float | None) -> DataFrame:
    """Missing values as the mean of the neighbours' old values, all at once; else the default."""
    bare = values.filter("value IS NULL").select(*by, "vid")
    near = bare.join(neighbors, "vid").join(values.select(*by, F.col("vid").alias("neighbor"), "value"), [*by, "neighbor"])
    mean = near.groupBy(*by, "vid").agg(F.avg("value").alias("_m"))
    out: Column = F.coalesce("value", "_m", *([F.lit(default)] if default is not None else []))
    return values.join(mean, [*by, "vid"], "left").select(*by, "vid", out.alias("value"))


def atlas_transfer(surface_map: DataFrame, edge_faces: DataFrame, face_values: DataFrame, atlas_vertices: DataFrame, atlas_neighbors: DataFrame) -> DataFrame:
    """``specimen, vid, value``: each atlas vertex takes the value of the first face on its mapped edge; the others the
    mean of their neighbours, or 0."""
    on_edge = surface_map.select("specimen", F.col("src_vertex").alias("vid"), F.least("c_vertex", "a_vertex").alias("a"), F.greatest("c_vertex", "a_vertex").alias("b"))
    mapped = on_edge.join(edge_faces, ["a", "b"]).join(face_values, ["specimen", "fid"]).select("specimen", "vid", "value")
    frame = atlas_vertices.select("vid").crossJoin(F.broadcast(surface_map.select("specimen").distinct()))
    return _fill(frame.join(mapped, ["specimen", "vid"], "left"), atlas_neighbors, ["specimen"], 0.0)


def atlas_mean(values: DataFrame, by: list[str], specimens: DataFrame | None = None) -> DataFrame:
    """The mean over specimens at each vertex; null if one of them has none. ``values(specimen, by, vid, value)``."""
    n = (specimens if specimens is not None else values.select("specimen").distinct()).agg(F.count("*").alias("_n"))
    mean = values.groupBy(*by, "vid").agg(F.avg("value").alias("_m"), F.count("value").alias("_c"))
    return mean.crossJoin(F.broadcast(n)).select(*by, "vid", F.when(F.col("_c") == F.col("_n"), F.col("_m")).alias("value"))


def barycentric_transfer(surface_map: DataFrame, faces: DataFrame, edge_faces: DataFrame, face_values: DataFrame, atlas_vertices: DataFrame, atlas_neighbors: DataFrame) -> DataFrame:
    """Vertex values are means over their faces; an atlas vertex mixes those of the three corners of its mapped face by
    the barycentric weights, and the mean over specimens follows. Empty vertices are filled from their neighbours."""
    at_vertex = M.corners(faces).join(face_values, "fid").groupBy("specimen", F.col("vid").alias("corner")).agg(F.avg("value").alias("v"))
    on = surface_map.withColumns({"a": F.least("c_vertex", "a_vertex"), "b": F.greatest("c_vertex", "a_vertex")}).join(edge_faces, ["a", "b"]).join(faces.select("fid", "v0", "v1", "v2"), "fid")
    third = F.col("v0") + F.col("v1") + F.col("v2") - F.col("c_vertex") - F.col("a_vertex")
    parts = F.explode(F.array(*[F.struct(v.alias("corner"), F.col(w).alias("w")) for v, w in ((F.col("c_vertex"), "alpha"), (F.col("a_vertex"), "beta"), (third, "gamma"))]))
    rows = on.select("specimen", F.col("src_vertex").alias("vid"), parts.alias("p")).select("specimen", "vid", "p.*").join(at_vertex, ["specimen", "corner"])
    mixed = rows.groupBy("specimen", "vid").agg(F.sum(F.col("w") * F.col("v")).alias("value"))
    frame = atlas_vertices.select("vid").crossJoin(F.broadcast(surface_map.select("specimen").distinct()))
    full = _fill(frame.join(mixed, ["specimen", "vid"], "left"), atlas_neighbors, ["specimen"], None)
    return full.groupBy("vid").agg(F.avg("value").alias("value"))


def stage_atlas(face_values: DataFrame, surface_map: DataFrame, edge_faces: DataFrame, atlas_vertices: DataFrame, atlas_neighbors: DataFrame, catalog: DataFrame) -> DataFrame:
    """``stage, vid, value``: the transfer of every specimen to analyze, averaged by stage."""
    chosen = catalog.filter("to_analyze").select("specimen", "stage")
    moved = atlas_transfer(surface_map.join(chosen.select("specimen"), "specimen", "left_semi"), edge_faces, face_values, atlas_vertices, atlas_neighbors)
    n = chosen.join(surface_map.select("specimen").distinct(), "specimen", "left_semi").groupBy("stage").agg(F.count("*").alias("_n"))
    mean = moved.join(chosen, "specimen").groupBy("stage", "vid").agg(F.avg("value").alias("_m"), F.count("value").alias("_c"))
    return mean.join(n, "stage").select("stage", "vid", F.when(F.col("_c") == F.col("_n"), F.col("_m")).alias("value"))


def atlas_range(values: DataFrame, by: list[str]) -> DataFrame:
    """p0.1 and p99.9, or p5 and p95 where p99.9 exceeds 10."""
    r = percentiles(values, by, "value", {"_a": 0.001, "_b": 0.999, "_c": 0.05, "_d": 0.95})
    wide = F.col("_b") > 10
    return r.select(*by, F.when(wide, F.col("_c")).otherwise(F.col("_a")).alias("lo"), F.when(wide, F.col("_d")).otherwise(F.col("_b")).alias("hi"))


def map_range(values: DataFrame, by: list[str], counted: bool = False) -> DataFrame:
    """The range of a single map: p1 and p99 of its values, or its ends for a ``counted`` feature such as cell division."""
    if counted:
        return values.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return percentiles(values, by, "value", {"lo": 0.01, "hi": 0.99})


def quantize_bins(values: DataFrame, ranges: DataFrame, by: list[str], bins: int) -> DataFrame:
    """The equal bin of [lo, hi] that a value lies in, 0 ... bins - 1; -1 below and ``bins`` from hi on."""
    at = F.when(F.col("value") < F.col("lo"), -1).when(F.col("value") >= F.col("hi"), bins).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    joined = values.join(ranges, by) if by else values.crossJoin(F.broadcast(ranges))
    return joined.withColumn("bin", at.cast("long")).drop("lo", "hi")


def global_minmax(df: DataFrame, value: str) -> DataFrame:
    """Scales over the whole table from 0 to 1; a constant column stays as it is."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    out = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col(value))
    return df.crossJoin(F.broadcast(ends)).withColumn(value, out).drop("_lo", "_hi")


def atlas_normalized(stages: list[DataFrame], bins: int) -> DataFrame:
    """Stage atlases below each other with the bins of their common range."""
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return quantize_bins(out, atlas_range(out, []), [], bins)

