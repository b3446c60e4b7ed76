"""Queries of surface maps and atlases."""

from pyspark.sql import functions as F

from ..operators import atlas as A
from ..operators import mesh as M
from .mesh import BALL, EDG, PTS
from .registry import query
from .voxels import r6

# Faces' values differ by specimen; cells without a number divisible by 11 have one.
FV = "fv AS (SELECT s.specimen, f.fid, CASE WHEN f.cell_id % 11 = 3 THEN NULL ELSE (f.fid % 17) / 2e0 + s.specimen END AS value FROM fx_faces f CROSS JOIN (SELECT 1 AS specimen UNION ALL SELECT 2 UNION ALL SELECT 3) s)"
NEI = f"{EDG}, ef AS (SELECT a, b, min(fid) AS fid FROM edg GROUP BY 1, 2), nb AS (SELECT a AS vid, b AS neighbor FROM edg UNION SELECT b, a FROM edg)"
TRANSFER = f"""{FV}, {NEI}, mp AS (SELECT m.specimen, m.src_vertex AS vid, fv.value FROM fx_surface_map m JOIN ef ON ef.a = least(c_vertex, a_vertex) AND ef.b = greatest(c_vertex, a_vertex) JOIN fv ON fv.specimen = m.specimen AND fv.fid = ef.fid),
fr AS (SELECT s.specimen, v.vid, mp.value FROM fx_vertices v CROSS JOIN (SELECT DISTINCT specimen FROM fx_surface_map) s LEFT JOIN mp ON mp.specimen = s.specimen AND mp.vid = v.vid),
av AS (SELECT fr.specimen, fr.vid, avg(o.value) AS m FROM fr JOIN nb ON nb.vid = fr.vid JOIN fr o ON o.specimen = fr.specimen AND o.vid = nb.neighbor WHERE fr.value IS NULL GROUP BY 1, 2),
tr AS (SELECT fr.specimen, fr.vid, coalesce(fr.value, av.m, 0e0) AS value FROM fr LEFT JOIN av USING (specimen, vid))"""


def face_values(d):
    return d.sql(FV.split("(", 1)[1][:-1])


def transfer(d):
    f = d.fx_faces
    return A.atlas_transfer(d.fx_surface_map, M.edge_to_face(f), face_values(d), d.fx_vertices, M.vertex_neighbors(f))


@query("snap_landmarks", """WITH n AS (SELECT * FROM fx_landmarks WHERE name NOT LIKE 'U%') SELECT name, ord, vid, round(dist, 6) AS dist FROM (SELECT n.name, n.ord, v.vid, sqrt((n.x-v.x)*(n.x-v.x)+(n.y-v.y)*(n.y-v.y)+(n.z-v.z)*(n.z-v.z)) AS dist,
row_number() OVER (PARTITION BY n.name ORDER BY sqrt((n.x-v.x)*(n.x-v.x)+(n.y-v.y)*(n.y-v.y)+(n.z-v.z)*(n.z-v.z)), v.vid) AS r FROM n CROSS JOIN fx_vertices v) t WHERE r = 1""")
def _(d):
    from ..sources.files import landmarks_from_json

    doc = d.fx_landmarks.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", F.array("x", "y", "z"))))).alias("value"))
    names = d.fx_landmarks.filter("name NOT LIKE 'U%'").select("name", "ord")
    return r6(A.snap_landmarks(landmarks_from_json(doc), d.fx_vertices, names, 8.0), "dist")


CELLC = f"cc AS (SELECT cell_id, avg((x0+x1+x2)/3) AS x, avg((y0+y1+y2)/3) AS y, avg((z0+z1+z2)/3) AS z FROM ({PTS}) p GROUP BY 1)"
CMAP = f"""{CELLC}, cmap AS (SELECT fid, cell_id, dist FROM (SELECT f.fid, c.cell_id, sqrt((f.x-c.x)*(f.x-c.x)+(f.y-c.y)*(f.y-c.y)+(f.z-c.z)*(f.z-c.z)) AS dist, row_number() OVER (PARTITION BY f.fid ORDER BY sqrt((f.x-c.x)*(f.x-c.x)+(f.y-c.y)*(f.y-c.y)+(f.z-c.z)*(f.z-c.z)), c.cell_id) AS r FROM cen f CROSS JOIN cc c WHERE c.cell_id IN (SELECT cell_id FROM fx_cells WHERE level = 'Nuclei')) t WHERE r = 1)"""
CEN_ = f"cen AS (SELECT fid, cell_id, (x0+x1+x2)/3 AS x, (y0+y1+y2)/3 AS y, (z0+z1+z2)/3 AS z FROM ({PTS}) p)"


def mapped(d):
    v, f = d.fx_vertices.drop("cell_id"), d.fx_faces
    features = d.sql("SELECT cell_id, perpendicularity AS value FROM fx_cells WHERE level = 'Nuclei'")
    return A.cell_map(v, f, M.cell_centroids(v, f), features, 20.0), features


@query("cell_map", f"WITH {CEN_}, {CMAP} SELECT fid, cell_id, round(dist, 6) AS dist FROM cmap")
def _(d):
    return r6(mapped(d)[0], "dist")


@query("surface_feature_map", f"""WITH {BALL.format(r=16)}, {CMAP}, own AS (SELECT fid, perpendicularity AS own FROM cmap LEFT JOIN fx_cells USING (cell_id)), nbh AS (SELECT DISTINCT seed AS face, node AS neighbor FROM walk)
SELECT o.fid, round(coalesce(m.m, o.own), 6) AS value FROM own o LEFT JOIN (SELECT face AS fid, avg(own.own) AS m FROM nbh JOIN own ON own.fid = nbh.neighbor GROUP BY 1) m USING (fid)""", recursive=True)
def _(d):
    cells, features = mapped(d)
    near = A.face_neighborhoods(d.fx_vertices.drop("cell_id"), d.fx_faces, 16.0)
    return r6(A.surface_feature_map(cells, near, features, "value", []), "value")


@query("atlas_transfer", f"WITH {TRANSFER} SELECT specimen, vid, round(value, 6) AS value FROM tr")
def _(d):
    return r6(transfer(d), "value")


@query("atlas_mean", f"WITH {TRANSFER}, t AS (SELECT specimen, vid, CASE WHEN vid % 13 = specimen THEN NULL ELSE value END AS value FROM tr) SELECT vid, round(CASE WHEN count(value) = 3 THEN avg(value) END, 6) AS value FROM t GROUP BY 1")
def _(d):
    holes = transfer(d).withColumn("value", F.expr("CASE WHEN vid % 13 = specimen THEN NULL ELSE value END"))
    return r6(A.atlas_mean(holes, []), "value")


@query("barycentric_transfer", f"""WITH {FV}, {NEI}, vv AS (SELECT specimen, vid, avg(value) AS v FROM (SELECT fid, v0 AS vid FROM fx_faces UNION ALL SELECT fid, v1 FROM fx_faces UNION ALL SELECT fid, v2 FROM fx_faces) c JOIN fv USING (fid) GROUP BY 1, 2),
mx AS (SELECT m.specimen, m.src_vertex AS vid, m.c_vertex AS c0, m.a_vertex AS c1, f.v0+f.v1+f.v2-m.c_vertex-m.a_vertex AS c2, alpha, beta, gamma FROM fx_surface_map m JOIN ef ON ef.a = least(c_vertex, a_vertex) AND ef.b = greatest(c_vertex, a_vertex) JOIN fx_faces f ON f.fid = ef.fid),
mv AS (SELECT mx.specimen, mx.vid, coalesce(alpha*a.v, 0) + coalesce(beta*b.v, 0) + coalesce(gamma*c.v, 0) AS value FROM mx JOIN vv a ON a.specimen = mx.specimen AND a.vid = c0 JOIN vv b ON b.specimen = mx.specimen AND b.vid = c1 JOIN vv c ON c.specimen = mx.specimen AND c.vid = c2 WHERE a.v IS NOT NULL OR b.v IS NOT NULL OR c.v IS NOT NULL),
fr AS (SELECT s.specimen, v.vid, mv.value FROM fx_vertices v CROSS JOIN (SELECT DISTINCT specimen FROM fx_surface_map) s LEFT JOIN mv ON mv.specimen = s.specimen AND mv.vid = v.vid),
av AS (SELECT fr.specimen, fr.vid, avg(o.value) AS m FROM fr JOIN nb ON nb.vid = fr.vid JOIN fr o ON o.specimen = fr.specimen AND o.vid = nb.neighbor WHERE fr.value IS NULL GROUP BY 1, 2)
SELECT vid, round(avg(coalesce(fr.value, av.m)), 6) AS value FROM fr LEFT JOIN av USING (specimen, vid) GROUP BY 1""")
def _(d):
    f = d.fx_faces
    return r6(A.barycentric_transfer(d.fx_surface_map, f, M.edge_to_face(f), face_values(d), d.fx_vertices, M.vertex_neighbors(f)), "value")


STAGES = "st AS (SELECT t.specimen, t.vid, t.value, c.stage FROM tr t JOIN (SELECT specimen, stage FROM fx_catalog WHERE to_analyze) c USING (specimen))"


def staged(d):
    f = d.fx_faces
    return A.stage_atlas(face_values(d), d.fx_surface_map, M.edge_to_face(f), d.fx_vertices, M.vertex_neighbors(f), d.fx_catalog)


@query("stage_atlas", f"WITH {TRANSFER}, {STAGES} SELECT stage, vid, round(avg(value), 6) AS value FROM st GROUP BY 1, 2")
def _(d):
    return r6(staged(d), "value")


@query("atlas_range", "WITH v AS (SELECT level, volume / 5e4 AS value FROM fx_cells UNION ALL SELECT 'Small', sphericity FROM fx_cells) SELECT level, round(CASE WHEN quantile_cont(value, 0.999) > 10 THEN quantile_cont(value, 0.05) ELSE quantile_cont(value, 0.001) END, 6) AS lo, round(CASE WHEN quantile_cont(value, 0.999) > 10 THEN quantile_cont(value, 0.95) ELSE quantile_cont(value, 0.999) END, 6) AS hi FROM v GROUP BY 1")
def _(d):
    v = d.sql("SELECT level, volume / 5e4 AS value FROM fx_cells UNION ALL SELECT 'Small', sphericity FROM fx_cells")
    return r6(A.atlas_range(v, ["level"]), "lo", "hi")


@query("map_range", """WITH v AS (SELECT specimen, volume / 5e4 AS value, cell_division FROM fx_cells WHERE specimen % 3 > 0) SELECT 'volume' AS feature, specimen % 20 AS map, round(quantile_cont(value, 0.01), 6) AS lo, round(quantile_cont(value, 0.99), 6) AS hi FROM v GROUP BY 2
UNION ALL SELECT 'cell_division', specimen % 20, min(cell_division), max(cell_division) FROM v GROUP BY 2""")
def _(d):
    """The ranges of a feature and of a counted one, map by map."""
    v = d.sql("SELECT specimen % 20 AS map, volume / 5e4 AS value, cell_division * 1e0 AS c FROM fx_cells WHERE specimen % 3 > 0")
    one = A.map_range(v, ["map"]).withColumn("feature", F.lit("volume"))
    return r6(one.unionByName(A.map_range(v.select("map", F.col("c").alias("value")), ["map"], True).withColumn("feature", F.lit("cell_division"))), "lo", "hi")


@query("quantize_bins", """WITH r AS (SELECT level, quantile_cont(volume, 0.05) AS lo, quantile_cont(volume, 0.95) AS hi FROM fx_cells GROUP BY 1) SELECT cell_id, CAST(CASE WHEN volume < lo THEN -1 WHEN volume >= hi THEN 64 ELSE least(floor((volume - lo)/(hi - lo)*64), 63) END AS BIGINT) AS bin FROM fx_cells JOIN r USING (level)""")
def _(d):
    v = d.fx_cells.select("cell_id", "level", F.col("volume").alias("value"))
    r = v.groupBy("level").agg(F.percentile("value", F.lit(0.05)).alias("lo"), F.percentile("value", F.lit(0.95)).alias("hi"))
    return A.quantize_bins(v, r, ["level"], 64).select("cell_id", "bin")


@query("global_minmax", "SELECT cell_id, round((volume - min(volume) OVER ())/(max(volume) OVER () - min(volume) OVER ()), 6) AS volume FROM fx_cells")
def _(d):
    return r6(A.global_minmax(d.fx_cells.select("cell_id", "volume"), "volume"), "volume")


@query("atlas_normalized", f"""WITH {TRANSFER}, {STAGES}, v AS (SELECT stage, vid, avg(value) AS value FROM st GROUP BY 1, 2), r AS (SELECT CASE WHEN quantile_cont(value, 0.999) > 10 THEN quantile_cont(value, 0.05) ELSE quantile_cont(value, 0.001) END AS lo, CASE WHEN quantile_cont(value, 0.999) > 10 THEN quantile_cont(value, 0.95) ELSE quantile_cont(value, 0.999) END AS hi FROM v)
SELECT stage, vid, round(value, 6) AS value, CAST(CASE WHEN value < lo THEN -1 WHEN value >= hi THEN 1024 ELSE least(floor((value - lo)/(hi - lo)*1024), 1023) END AS BIGINT) AS bin FROM v CROSS JOIN r""")
def _(d):
    s = staged(d)
    return r6(A.atlas_normalized([s.filter("stage <= 'Gr3'"), s.filter("stage > 'Gr3'")], 1024), "value")
