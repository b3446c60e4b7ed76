"""Queries of mesh, neighbourhood and distance operators."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import atlas as A
from ..operators import mesh as M
from ..operators import spatial as P
from ..workspace import Workspace
from .registry import eigen_sql, query
from .voxels import r6

PTS = "SELECT f.fid, f.cell_id, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM fx_faces f JOIN fx_vertices a ON a.vid = f.v0 JOIN fx_vertices b ON b.vid = f.v1 JOIN fx_vertices c ON c.vid = f.v2"
CEN = f"cen AS (SELECT fid, cell_id, (x0+x1+x2)/3 AS x, (y0+y1+y2)/3 AS y, (z0+z1+z2)/3 AS z FROM ({PTS}) p)"
EDG = "edg AS (SELECT fid, least(v0, v1) AS a, greatest(v0, v1) AS b FROM fx_faces UNION ALL SELECT fid, least(v1, v2), greatest(v1, v2) FROM fx_faces UNION ALL SELECT fid, least(v0, v2), greatest(v0, v2) FROM fx_faces)"
ADJ = f"{CEN}, {EDG}, adj AS (SELECT DISTINCT a.fid AS src, b.fid AS dst, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) AS w FROM edg a JOIN edg b ON a.a = b.a AND a.b = b.b AND a.fid <> b.fid JOIN cen p ON p.fid = a.fid JOIN cen q ON q.fid = b.fid)"


@query("face_centroids", f"WITH {CEN} SELECT fid, cell_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM cen")
def _(d):
    return r6(M.face_centroids(d.fx_vertices, d.fx_faces), "x", "y", "z")


@query("cell_centroids", f"SELECT cell_id, round(avg((x0+x1+x2)/3), 6) AS x, round(avg((y0+y1+y2)/3), 6) AS y, round(avg((z0+z1+z2)/3), 6) AS z FROM ({PTS}) p GROUP BY 1")
def _(d):
    return r6(M.cell_centroids(d.fx_vertices, d.fx_faces), "x", "y", "z")


@query("face_adjacency", f"WITH {ADJ} SELECT src, dst, round(w, 6) AS w FROM adj")
def _(d):
    return r6(M.face_adjacency(d.fx_vertices, d.fx_faces), "w")


@query("vertex_neighbors", f"WITH {EDG} SELECT a AS vid, b AS neighbor FROM edg UNION SELECT b, a FROM edg")
def _(d):
    return M.vertex_neighbors(d.fx_faces)


@query("edge_to_face", f"WITH {EDG} SELECT a, b, min(fid) AS fid FROM edg GROUP BY 1, 2")
def _(d):
    return M.edge_to_face(d.fx_faces)


def adjacency(d):
    """Written, since each round of a search reads it."""
    return Workspace(d.spark).write(M.face_adjacency(d.fx_vertices, d.fx_faces))


# The recursion carries whole paths' lengths, so its SQL stays with a radius that few faces lie within.
BALL = f"{ADJ}, walk AS (SELECT fid AS seed, fid AS node, 0e0 AS dist FROM cen UNION SELECT seed, dst, dist + w FROM walk JOIN adj ON src = node WHERE dist + w <= {{r}})"


@query("face_neighborhoods", f"WITH {BALL.format(r=16)} SELECT seed, node, round(min(dist), 6) AS dist FROM walk GROUP BY 1, 2", recursive=True)
def _(d):
    near = A.face_neighborhoods(d.fx_vertices.drop("cell_id"), d.fx_faces, 16.0)
    return r6(near.select(F.col("face").alias("seed"), F.col("neighbor").alias("node"), "dist"), "dist")


@query("face_neighborhoods_wide")
def _(d):
    """The radius of membranes' neighbourhoods, 50, which the recursive SQL is too slow for: sizes and mean distances."""
    return r6(A.neighborhood_sizes(d.fx_vertices.drop("cell_id"), d.fx_faces, 50.0), "dist")


@query("geodesic_ball", f"WITH {BALL.format(r=14)}, b AS (SELECT seed, node, min(dist) AS dist FROM walk GROUP BY 1, 2), k AS (SELECT s.seed, min(r.r) AS r FROM (SELECT DISTINCT seed FROM b) s CROSS JOIN (SELECT unnest(range(4, 15)) AS r) r WHERE (SELECT count(*) FROM b WHERE b.seed = s.seed AND b.dist <= r.r) >= 3 GROUP BY 1) SELECT b.seed, b.node, round(b.dist, 6) AS dist FROM b JOIN k USING (seed) WHERE b.dist <= k.r", recursive=True)
def _(d):
    seeds = d.fx_faces.select(F.col("fid").alias("seed"))
    return r6(M.geodesic_ball(seeds, adjacency(d), 4.0, 3, 10), "dist")


@query("geodesic_path", f"WITH {BALL.format(r=16)}, p AS (SELECT seed, node, min(dist) AS dist FROM walk GROUP BY 1, 2) SELECT seed, node AS target, round(dist, 6) AS dist FROM p WHERE node = seed + 2", recursive=True)
def _(d):
    seeds = d.fx_faces.select(F.col("fid").alias("seed"), (F.col("fid") + 2).alias("target"))
    return r6(M.geodesic_path(seeds, adjacency(d), 16.0).select("seed", "target", "dist"), "dist")


# The normal: the longest cross product of two rows of the matrix less its least eigenvalue.
ROWS = {"1": ("xx-e3", "xy", "xz"), "2": ("xy", "yy-e3", "yz"), "3": ("xz", "yz", "zz-e3")}


def cross_sql(i: str, j: str) -> str:
    (a, b, c), (d, e, f) = ROWS[i], ROWS[j]
    return f"SELECT cell_id, n, ({b})*({f}) - ({c})*({e}) AS vx, ({c})*({d}) - ({a})*({f}) AS vy, ({a})*({e}) - ({b})*({d}) AS vz FROM eig"


@query("plane_fit", f"""WITH {CEN}, {eigen_sql('cen', 'cell_id')}, cr AS ({cross_sql('1', '2')} UNION ALL {cross_sql('1', '3')} UNION ALL {cross_sql('2', '3')}),
b AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY vx*vx + vy*vy + vz*vz DESC) AS r FROM cr)
SELECT cell_id, {', '.join(f'round(CASE WHEN n < 3 THEN {int(i == 2)}e0 ELSE abs({v})/sqrt(vx*vx + vy*vy + vz*vz) END, 5) AS n{i}' for i, v in enumerate(('vx', 'vy', 'vz')))} FROM b WHERE r = 1""")
def _(d):
    points = M.face_centroids(d.fx_vertices, d.fx_faces)
    return M.plane_fit(points, ["cell_id"]).select("cell_id", *[F.round(F.abs(F.col("normal")[i]), 5).alias(f"n{i}") for i in range(3)])


@query("ellipsoid_axes", f"WITH {eigen_sql('fx_vertices', 'cell_id', 'covar_samp')} SELECT cell_id, {', '.join(f'round(CASE WHEN n < 4 THEN 1e0 ELSE sqrt(greatest(e{i + 1}, 0e0)) END, 4) AS pca{i}' for i in range(3))} FROM eig")
def _(d):
    points = d.fx_vertices.select("cell_id", "x", "y", "z")
    return M.ellipsoid_axes(points, ["cell_id"]).select("cell_id", *[F.round(F.col("lengths")[i], 4).alias(f"pca{i}") for i in range(3)])


@query("ellipsoid_mvee")
def _(d):
    """The ellipsoid of least volume, an iteration that SQL can't express."""
    points = d.fx_vertices.select("cell_id", "x", "y", "z")
    return M.ellipsoid_axes(points, ["cell_id"], "mvee").select("cell_id", *[F.round(F.col("lengths")[i], 4).alias(f"mvee{i}") for i in range(3)])


@query("perpendicularity")
def _(d):
    v, f = d.fx_vertices, d.fx_faces
    return r6(M.perpendicularity(v.select("vid", "x", "y", "z"), f, v.select("vid", "x", "y", "z"), f, 12.0, 20.0), "angle", "perpendicularity")


@query("sphericity_cov", f"""WITH pt AS (SELECT DISTINCT c.cell_id, v.vid, v.x, v.y, v.z FROM (SELECT cell_id, v0 AS vid FROM fx_faces UNION ALL SELECT cell_id, v1 FROM fx_faces UNION ALL SELECT cell_id, v2 FROM fx_faces) c JOIN fx_vertices v ON v.vid = c.vid), {eigen_sql('pt', 'cell_id', 'covar_samp')}
SELECT cell_id, round(CASE WHEN e1 > 0 THEN greatest(e3, 0e0)/e1 END, 6) AS sphericity FROM eig""")
def _(d):
    return r6(M.sphericity_cov(d.fx_vertices.drop("cell_id"), d.fx_faces), "sphericity")


@query("sphericity_volume", f"""WITH p AS (SELECT cell_id, x0*(y1*z2-z1*y2) + y0*(z1*x2-x1*z2) + z0*(x1*y2-y1*x2) AS v6, sqrt(power((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0), 2) + power((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0), 2) + power((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0), 2)) AS a2 FROM ({PTS}) p),
s AS (SELECT cell_id, abs(sum(v6/6)) AS volume, sum(a2/2) AS area FROM p GROUP BY 1) SELECT cell_id, round(volume, 4) AS volume, round(area, 4) AS area, round(36*pi()*volume*volume/(area*area*area), 6) AS sphericity FROM s""")
def _(d):
    out = M.sphericity_volume(d.fx_vertices.drop("cell_id"), d.fx_faces)
    return out.select("cell_id", F.round("volume", 4).alias("volume"), F.round("area", 4).alias("area"), F.round("sphericity", 6).alias("sphericity"))


@query("mesh_features")
def _(d):
    v, f = d.fx_vertices.select("vid", "x", "y", "z"), d.fx_faces
    out = M.mesh_features(v, f, v, f, 12.0, 20.0)
    return r6(out, "angle", "perpendicularity", "sphericity", "columnarity", "columnarity_parallel")


@query("mesh_concat", """WITH v AS (SELECT cell_id AS mesh_id, vid AS old, row_number() OVER (PARTITION BY cell_id ORDER BY vid) - 1 AS vid FROM fx_vertices), s AS (SELECT mesh_id, sum(n) OVER (ORDER BY mesh_id) - n AS start FROM (SELECT mesh_id, count(*) AS n FROM v GROUP BY 1) t)
SELECT v.mesh_id, v.old, CAST(v.vid + s.start AS BIGINT) AS vid FROM v JOIN s USING (mesh_id)""")
def _(d):
    v = d.sql("SELECT cell_id AS mesh_id, vid AS old, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY vid) - 1 AS BIGINT) AS vid FROM fx_vertices")
    faces = d.sql("SELECT cell_id AS mesh_id, fid, v0, v1, v2 FROM fx_faces")
    return M.mesh_concat(v, faces)[0].select("mesh_id", "old", "vid")


@query("submesh", """WITH k AS (SELECT * FROM fx_faces WHERE cell_id IN (SELECT cell_id FROM fx_cells WHERE level = 'Nuclei')), u AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM (SELECT v0 AS vid FROM k UNION SELECT v1 FROM k UNION SELECT v2 FROM k) t)
SELECT fid, CAST(a.new AS BIGINT) AS v0, CAST(b.new AS BIGINT) AS v1, CAST(c.new AS BIGINT) AS v2 FROM k JOIN u a ON a.vid = v0 JOIN u b ON b.vid = v1 JOIN u c ON c.vid = v2""")
def _(d):
    v, f = (x.withColumn("mesh_id", F.lit(0)) for x in (d.fx_vertices.drop("cell_id"), d.fx_faces))
    keep = d.sql("SELECT DISTINCT 0 AS mesh_id, cell_id FROM fx_faces WHERE cell_id IN (SELECT cell_id FROM fx_cells WHERE level = 'Nuclei')")
    return M.submesh(v, f, keep, ["mesh_id"])[1].select("fid", "v0", "v1", "v2")


@query("closed_surface", f"WITH {EDG.replace('SELECT fid,', 'SELECT cell_id, fid,')} SELECT cell_id, bool_and(n = 2) AS closed FROM (SELECT cell_id, a, b, count(*) AS n FROM edg GROUP BY 1, 2, 3) t GROUP BY 1")
def _(d):
    return M.closed_surface(d.fx_faces, ["cell_id"])


SMOOTH = ", ".join(f"s{k} AS MATERIALIZED (SELECT v.vid, v.x + 8e-1 * (coalesce(avg(n.x), v.x) - v.x) AS x, v.y + 8e-1 * (coalesce(avg(n.y), v.y) - v.y) AS y, v.z + 8e-1 * (coalesce(avg(n.z), v.z) - v.z) AS z FROM {f's{k - 1}' if k else 'fx_vertices'} v LEFT JOIN nb ON nb.vid = v.vid LEFT JOIN {f's{k - 1}' if k else 'fx_vertices'} n ON n.vid = nb.neighbor GROUP BY v.vid, v.x, v.y, v.z)" for k in range(40))


@query("laplacian_smooth", f"WITH {EDG}, nb AS MATERIALIZED (SELECT a AS vid, b AS neighbor FROM edg UNION SELECT b, a FROM edg), {SMOOTH} SELECT vid, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM s39")
def _(d):
    out = M.laplacian_smooth(d.fx_vertices, d.fx_faces, 0.8, 40)
    return out.select("vid", *[F.round(c, 5).alias(c) for c in "xyz"])


@query("vertex_normals", f"""WITH n AS (SELECT fid, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS nx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS ny, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS nz FROM ({PTS}) p),
s AS (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT fid, v0 AS vid FROM fx_faces UNION ALL SELECT fid, v1 FROM fx_faces UNION ALL SELECT fid, v2 FROM fx_faces) c JOIN n USING (fid) GROUP BY 1)
SELECT vid, round(nx/sqrt(nx*nx+ny*ny+nz*nz), 6) AS nx, round(ny/sqrt(nx*nx+ny*ny+nz*nz), 6) AS ny, round(nz/sqrt(nx*nx+ny*ny+nz*nz), 6) AS nz FROM s""")
def _(d):
    return r6(M.vertex_normals(d.fx_vertices.drop("cell_id"), d.fx_faces), "nx", "ny", "nz")


@query("mesh_sizes", "WITH n AS (SELECT cell_id, count(*) AS n FROM fx_faces GROUP BY 1), p AS (SELECT DISTINCT cell_id AS left, cell_id + 1 AS right FROM fx_vertices) SELECT p.left, p.right, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN coalesce(a.n, 0) < coalesce(b.n, 0) THEN 'left' WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'right' ELSE 'same' END AS coarser FROM p LEFT JOIN n a ON a.cell_id = p.left LEFT JOIN n b ON b.cell_id = p.right")
def _(d):
    """Each cell's mesh beside that of the cell with the next number."""
    return M.mesh_sizes(d.fx_faces, "cell_id", d.sql("SELECT DISTINCT cell_id AS left, cell_id + 1 AS right FROM fx_vertices"))


@query("planar_uv", "SELECT cell_id, vid, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) AS u, round((y - min(y) OVER w) / CASE WHEN max(y) OVER w > min(y) OVER w THEN max(y) OVER w - min(y) OVER w ELSE 1 END, 6) AS v FROM fx_vertices WINDOW w AS (PARTITION BY cell_id)")
def _(d):
    return r6(M.planar_uv(d.fx_vertices, ["cell_id"]), "u", "v")


def points(d):
    a, b = d.sql("SELECT pid, ax AS x, ay AS y, az AS z FROM fx_points"), d.sql("SELECT pid AS tid, bx AS x, by_ AS y, bz AS z FROM fx_points")
    return a, b


@query("nearest_join", """SELECT pid, tid, round(dist, 6) AS dist FROM (SELECT a.pid, b.pid AS tid, sqrt((ax-b.bx)*(ax-b.bx)+(ay-b.by_)*(ay-b.by_)+(az-b.bz)*(az-b.bz)) AS dist, row_number() OVER (PARTITION BY a.pid ORDER BY sqrt((ax-b.bx)*(ax-b.bx)+(ay-b.by_)*(ay-b.by_)+(az-b.bz)*(az-b.bz)), b.pid) AS r
FROM (SELECT pid, ax, ay, az FROM fx_points) a CROSS JOIN (SELECT pid, bx, by_, bz FROM fx_points) b) t WHERE r = 1""")
def _(d):
    return r6(P.nearest_join(*points(d), 2.0), "dist")


@query("within_distance", "SELECT a.pid, EXISTS (SELECT 1 FROM fx_points b WHERE (a.ax-b.bx)*(a.ax-b.bx)+(a.ay-b.by_)*(a.ay-b.by_)+(a.az-b.bz)*(a.az-b.bz) <= 9) AS near FROM fx_points a")
def _(d):
    return P.within_distance(*points(d), 3.0).select("pid", "near")


@query("vector_angle", "SELECT pid, round(degrees(acos(greatest(least((ax*bx+ay*by_+az*bz)/(sqrt(ax*ax+ay*ay+az*az)*sqrt(bx*bx+by_*by_+bz*bz)), 1e0), -1e0))), 6) AS angle FROM fx_points")
def _(d):
    return d.fx_points.select("pid", F.round(C.vector_angle([F.col(c) for c in ("ax", "ay", "az")], [F.col(c) for c in ("bx", "by_", "bz")]), 6).alias("angle"))


@query("perp_curve", "SELECT pid, round(least(greatest(1 - exp(-(a - 90)*(a - 90)/1800), 0e0), 1e0), 6) AS perpendicularity FROM (SELECT pid, abs(ax) * 3 AS a FROM fx_points) t")
def _(d):
    return d.fx_points.select("pid", F.round(C.perpendicularity(F.abs("ax") * 3), 6).alias("perpendicularity"))
