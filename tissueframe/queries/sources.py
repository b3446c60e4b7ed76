"""Queries of files, catalogs and incremental stages: each writes files from the tables, then reads them."""

from pyspark.sql import functions as F

from ..operators import mesh as M
from ..operators.graph import numbered
from ..plans.incremental import incremental
from ..sources import catalog as C
from ..sources import files as S
from ..workspace import Workspace
from .registry import query
from .voxels import r6


FRAME = """b AS (SELECT specimen, max(x) AS mx, max(y) AS my, min(x) AS nx, min(y) AS ny FROM fx_volume GROUP BY 1), s AS (SELECT DISTINCT specimen, z FROM fx_volume),
f AS (SELECT s.specimen, x, y, z FROM b JOIN s USING (specimen), (SELECT unnest(range(25)) AS x) i, (SELECT unnest(range(25)) AS y) j WHERE x BETWEEN nx AND mx AND y BETWEEN ny AND my)"""


def nifti(d):
    folder = Workspace(d.spark).path("nifti")
    S.write_nifti(d.fx_volume, "specimen", folder, (0.38, 0.38, 0.5), slab_bytes=40_000).count()
    return folder


@query("read_nifti", f"WITH {FRAME} SELECT f.specimen, f.x, f.y, f.z, coalesce(v.intensity, 0e0) AS intensity FROM f LEFT JOIN fx_volume v ON v.specimen = f.specimen AND v.x = f.x AND v.y = f.y AND v.z = f.z")
def _(d):
    back = S.read_nifti(d.spark, f"{nifti(d)}/*.nii.gz", placed=True)
    return back.select(F.regexp_extract("path", r"volume_(\d+)", 1).cast("long").alias("specimen"), "x", "y", "z", "intensity")


@query("volume_meta", "SELECT specimen, CAST(max(x) - min(x) + 1 AS INTEGER) AS x_size, CAST(max(y) - min(y) + 1 AS INTEGER) AS y_size, CAST(max(z) - min(z) + 1 AS INTEGER) AS z_size, 0.38e0 AS x_res, 0.38e0 AS y_res, 0.5e0 AS z_res, round(min(z) * 0.5e0, 4) AS z_place FROM fx_volume GROUP BY 1")
def _(d):
    m = S.volume_metadata(d.spark, f"{nifti(d)}/*.nii.gz")
    return m.select(F.regexp_extract("path", r"volume_(\d+)", 1).cast("long").alias("specimen"), "x_size", "y_size", "z_size", "x_res", "y_res", "z_res", F.round(F.col("affine")[2][3], 4).alias("z_place"))


@query("nifti_box", f"WITH {FRAME} SELECT f.specimen, f.x, f.y, f.z, coalesce(v.intensity, 0e0) AS intensity FROM f LEFT JOIN fx_volume v ON v.specimen = f.specimen AND v.x = f.x AND v.y = f.y AND v.z = f.z WHERE f.z >= 5 AND f.z < 19 AND f.x > 2 AND f.y <= 20")
def _(d):
    """Slabs as images of their own, and a box of all of them: the filter reaches the scan, which skips slabs and slices."""
    folder = Workspace(d.spark).path("slabs")
    S.write_slabs(d.fx_volume, "specimen", folder, (0.38, 0.38, 0.5), slab_bytes=40_000)
    box = S.read_nifti(d.spark, folder, placed=True).filter("z >= 5 AND z < 19 AND x > 2 AND y <= 20")
    return box.select(F.regexp_extract("path", r"volume_(\d+)_z", 1).cast("long").alias("specimen"), "x", "y", "z", "intensity")


STORED = "SELECT specimen, max(x) + 1 AS x_size, max(y) + 1 AS y_size, 38e-2 + specimen % 3 / 1e2 AS x_res FROM fx_volume GROUP BY specimen"


@query("voxel_roundtrip", f"SELECT v.specimen, x, y, z, intensity, x_size, y_size, round(x_res, 6) AS x_res FROM fx_volume v JOIN ({STORED}) m ON m.specimen = v.specimen")
def _(d):
    folder = Workspace(d.spark).path("voxels")
    S.write_volume(d.fx_volume.select("specimen", "x", "y", "z", "intensity"), d.sql(STORED), folder, ["specimen"])
    voxels, meta = S.read_stored(d.spark, folder)
    return r6(voxels.join(meta, "specimen"), "x_res")


@query("features_csv", "SELECT cell_id, level, volume, cell_division, CAST(cell_id % 25 AS INTEGER) AS x, CAST(cell_id % 7 AS INTEGER) AS y, CAST(3 AS INTEGER) AS z FROM fx_cells")
def _(d):
    folder = Workspace(d.spark).path("csv")
    S.write_features(d.sql("SELECT cell_id, level, volume, cell_division, cell_id % 25 AS cx, cell_id % 7 AS cy, CAST(3 AS BIGINT) AS cz FROM fx_cells"), folder)
    back = S.read_features(d.spark, folder, "cell_id long, level string, volume double, cell_division long, centroids string")
    return back.select("cell_id", "level", "volume", "cell_division", "centroid.x", "centroid.y", "centroid.z")


@query("read_ply", "SELECT cell_id, count(*) AS faces, CAST(sum(fid) AS BIGINT) AS fids FROM (SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY fid) - 1 AS fid FROM fx_faces) t GROUP BY 1")
def _(d):
    folder = Workspace(d.spark).path("ply")
    v, f = (x.withColumn("mesh_id", F.col("cell_id")) for x in (d.fx_vertices, d.fx_faces))
    used = M.corners(f, ["mesh_id"]).select("mesh_id", "vid").distinct().join(v.drop("mesh_id"), "vid")
    S.ply_text(used, f, "mesh_id").write.partitionBy("mesh_id").text(folder)
    faces = S.read_ply(d.spark, f"{folder}/mesh_id=*")[1]
    return faces.groupBy("cell_id").agg(F.count("*").alias("faces"), F.sum("fid").alias("fids"))


@query("ply_parts", "SELECT c.cell_id, count(DISTINCT v.vid) AS vertices, CAST(sum(c.n) AS BIGINT) AS corners, round(sum(v.x * c.n), 4) AS sx, round(sum(v.z * c.n), 4) AS sz FROM (SELECT cell_id, vid, count(*) AS n FROM (SELECT cell_id, v0 AS vid FROM fx_faces UNION ALL SELECT cell_id, v1 FROM fx_faces UNION ALL SELECT cell_id, v2 FROM fx_faces) a GROUP BY 1, 2) c JOIN fx_vertices v ON v.vid = c.vid GROUP BY 1")
def _(d):
    """One mesh of all cells, written and read by several tasks; vertices that its faces name, by cell."""
    folder, work = Workspace(d.spark).path("parts"), Workspace(d.spark)
    order = numbered(d.fx_vertices.withColumn("mesh", F.lit(1)), ["mesh"], ["vid"], "at", work).select("vid", (F.col("at") - 1).alias("at"))
    place = lambda k: order.select(F.col("vid").alias(f"v{k}"), F.col("at").alias(f"at{k}"))
    f = d.fx_faces.join(place(0), "v0").join(place(1), "v1").join(place(2), "v2").select(F.lit(1).alias("mesh"), "fid", *[F.col(f"at{k}").alias(f"v{k}") for k in range(3)], "cell_id")
    S.write_ply(d.fx_vertices.withColumn("mesh", F.lit(1)), f, "mesh", folder)
    v, f = S.read_ply(d.spark, f"{folder}/mesh=1", folders=True, work=work)
    used = f.select("path", "cell_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).groupBy("path", "cell_id", "vid").agg(F.count("*").alias("n"))
    out = used.join(v.drop("cell_id"), ["path", "vid"]).groupBy("cell_id")
    return out.agg(F.count("*").alias("vertices"), F.sum("n").alias("corners"), F.round(F.sum(F.col("x") * F.col("n")), 4).alias("sx"), F.round(F.sum(F.col("z") * F.col("n")), 4).alias("sz"))


@query("surface_map_all", "SELECT specimen, src_vertex, c_vertex, a_vertex, alpha, beta, gamma FROM fx_surface_map")
@query("surface_map", "SELECT specimen, src_vertex, c_vertex, a_vertex, alpha, beta, gamma FROM fx_surface_map")
def _(d):
    """The maps of all specimens, each in a folder of its own; the specimen comes back from the path."""
    folder = Workspace(d.spark).path("maps")
    S.surface_map_lines(d.fx_surface_map, "specimen").write.partitionBy("specimen").text(folder)
    return S.read_surface_map(d.spark, folder).withColumn("specimen", F.regexp_extract("path", r"specimen=(\d+)", 1).cast("long")).drop("path")


@query("history_best", """WITH r AS (SELECT model, config, max(val_auc) AS best FROM fx_history GROUP BY 1, 2 HAVING count(*) > 1), a AS (SELECT model, count(DISTINCT config) AS runs FROM fx_history GROUP BY 1)
SELECT a.model, a.runs, b.completed, round(b.best, 6) AS best, (SELECT min(CAST(config AS VARCHAR)) FROM r WHERE r.model = a.model AND r.best = b.best) AS config FROM a JOIN (SELECT model, count(*) AS completed, max(best) AS best FROM r GROUP BY 1) b USING (model)""")
def _(d):
    h = d.fx_history.groupBy("model", "config").agg(F.transform(F.sort_array(F.collect_list(F.struct("epoch", "val_auc"))), lambda e: e["val_auc"]).alias("val_auc"))
    run = F.when(F.size("val_auc") > 1, F.struct("val_auc"))
    docs = h.groupBy("model", F.pmod("config", F.lit(64)).alias("_part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("config").cast("string"), run))), {"ignoreNullFields": "false"}).alias("value"))
    return r6(S.history_best(docs), "best")


@query("catalog_lookup", "SELECT DISTINCT c.specimen, g.stage FROM fx_cells c LEFT JOIN fx_catalog g ON g.specimen = c.specimen AND g.to_analyze")
def _(d):
    return C.find_group(d.fx_cells.select("specimen").distinct(), d.fx_catalog.filter("to_analyze"))


#: Paths with a specimen's name inside longer names, with none, and with several.
PATHS = """SELECT concat('/data/Gr', c_nationkey % 10 + 1, '/x0', c_custkey, '_E', c_nationkey % 4, CASE WHEN c_custkey % 5 = 0 THEN concat('-', c_custkey + 1, '_E1') ELSE '' END, 'mGFP.nii.gz') AS path FROM customer"""
KNOWN = "SELECT concat('0', c_custkey, '_E', c_nationkey % 3) AS specimen, c_custkey AS ord FROM customer UNION ALL SELECT concat('-', c_custkey, '_E1'), -c_custkey FROM customer"


@query("find_specimen", f"SELECT p.path, (SELECT min_by(k.specimen, k.ord) FROM ({KNOWN}) k WHERE contains(p.path, k.specimen)) AS specimen FROM ({PATHS}) p")
def _(d):
    return C.find_specimen(d.sql(PATHS), d.sql(KNOWN))


@query("find_specimen_all", """WITH known AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS specimen FROM customer WHERE c_custkey > 0), p AS (SELECT DISTINCT concat('/data/', c_nationkey, '/', c_custkey, '.nii') AS path FROM customer)
SELECT concat('/data/', c.c_nationkey, '/', c.c_custkey, '.nii') AS path, f.specimen FROM customer c JOIN (SELECT p.path, min_by(k.specimen, k.c_custkey) AS specimen FROM p LEFT JOIN known k ON contains(p.path, k.specimen) GROUP BY 1) f ON f.path = concat('/data/', c.c_nationkey, '/', c.c_custkey, '.nii')""")
def _(d):
    """All paths; those that hold no known name give null."""
    paths = d.sql("SELECT concat('/data/', c_nationkey, '/', c_custkey, '.nii') AS path FROM customer")
    known = d.sql("SELECT CAST(c_custkey AS STRING) AS specimen, c_custkey AS ord FROM customer WHERE c_custkey > 0")
    return C.find_specimen(paths, known)


LAID = """SELECT concat('/root/', stage, CASE specimen % 3 WHEN 0 THEN '/RawImages/' WHEN 1 THEN '/Segmentation/' ELSE '/Features/' END, CASE WHEN specimen % 3 = 2 THEN '' WHEN specimen % 2 = 0 THEN 'Nuclei/' ELSE 'Membrane/' END,
CASE WHEN specimen % 7 = 0 AND specimen % 3 < 2 THEN 'Filtered/' ELSE '' END, 's', specimen % 50 + 100, '_', specimen, CASE WHEN specimen % 11 = 0 THEN '.h5' ELSE '.nii.gz' END) AS path, stage, group_no, specimen % 3 AS t, specimen % 2 AS l, specimen % 7 = 0 AND specimen % 3 < 2 AS filtered, specimen % 50 + 100 AS s, specimen % 11 = 0 AS h5,
concat('s', specimen % 50 + 100, '_', specimen) AS name FROM fx_catalog"""
ASKED = """SELECT DISTINCT concat('s', specimen % 60 + 100, '_') AS specimen, CASE WHEN specimen % 3 = 2 THEN NULL WHEN specimen % 2 = 0 THEN 'Nuclei' ELSE 'Membrane' END AS level, CASE specimen % 3 WHEN 0 THEN 'RawImages' WHEN 1 THEN 'Segmentation' ELSE 'Features' END AS type, specimen % 7 = 0 AND specimen % 3 < 2 AS filtered FROM fx_catalog"""


TYPE = "CASE t WHEN 0 THEN 'RawImages' WHEN 1 THEN 'Segmentation' ELSE 'Features' END"
LEVEL = "CASE WHEN t = 2 THEN '' WHEN l = 0 THEN 'Nuclei' ELSE 'Membrane' END"


@query("resolve_path", f"""WITH l AS ({LAID}), a AS ({ASKED}), m AS (SELECT a.*, l.path, row_number() OVER (PARTITION BY a.specimen, a.level, a.type, a.filtered ORDER BY group_no, name) AS r
FROM a LEFT JOIN l ON contains(l.name, a.specimen) AND NOT h5 AND l.filtered = a.filtered AND {TYPE} = a.type AND {LEVEL} = coalesce(a.level, ''))
SELECT specimen, level, type, filtered, path FROM m WHERE r = 1""")
def _(d):
    groups = d.sql("SELECT DISTINCT stage, group_no AS ord FROM fx_catalog").withColumnRenamed("stage", "group")
    return C.resolve_path(d.sql(ASKED), d.sql(LAID).select("path"), groups)


@query("manifest", "SELECT DISTINCT CAST(specimen AS VARCHAR) AS specimen, 'Nuclei' AS level FROM fx_volume")
def _(d):
    folder = Workspace(d.spark).path("files")
    S.write_nifti(d.fx_volume.withColumn("name", F.concat("specimen", F.lit("_Nuclei"))), "name", folder).count()
    found = C.manifest(d.spark, folder)
    return C.list_inputs(found, "nii.gz").select(F.regexp_replace("specimen", "volume_", "").alias("specimen"), "level")


@query("missing_outputs", "SELECT specimen FROM fx_catalog WHERE specimen IN (SELECT specimen FROM fx_cells) AND specimen NOT IN (SELECT specimen FROM fx_cells WHERE cell_division = 1)")
def _(d):
    cells = d.fx_cells
    return C.missing_outputs(d.fx_catalog.select("specimen"), cells, cells.filter("cell_division = 1"))


@query("missing_attribute", "SELECT specimen FROM fx_cells GROUP BY 1 HAVING count(cell_division) = 0")
def _(d):
    return C.missing_attribute(d.fx_cells, "cell_division")


@query("incremental", "SELECT stage, count(*) AS cells FROM fx_cells JOIN fx_catalog USING (specimen) GROUP BY 1")
def _(d):
    """A step that runs twice: for the first stages, then for those still missing."""
    folder = Workspace(d.spark).path("stage")
    count = lambda df: df.groupBy("stage").agg(F.count("*").alias("cells"))
    catalog = d.fx_catalog.select("stage", "group_no").distinct()
    cells = d.fx_cells.join(d.fx_catalog.select("specimen", "stage"), "specimen")
    incremental(catalog.filter("group_no <= 5"), cells, folder, count, "stage")
    return incremental(catalog, cells, folder, count, "stage")
