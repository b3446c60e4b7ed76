import gzip

import numpy as np
import pytest

from tissueframe.queries import QUERIES
from tissueframe.sources import catalog, files

from .test_queries import SF


def test_all_surface_maps_and_paths(spark):
    got = QUERIES["surface_map"](spark, SF)
    assert {r.specimen for r in got.select("specimen").distinct().collect()} == {1, 2, 3}
    paths = QUERIES["find_specimen_all"](spark, SF)
    assert paths.count() == spark.read.parquet(f"{SF}/customer.parquet").count() and paths.filter("path LIKE '/data/0/%' AND specimen IS NOT NULL").count() > 0


def test_specimens_inside_names(spark):
    """A name may hold an id without separators around it; the first of the catalog wins."""
    paths = spark.createDataFrame([("/data/0806_E5_mGFP.nii.gz",), ("/x/20190806_E50.tif",), ("/none/a.nii",), ("/two/0119_E1-0806_E5",), ("E",)], "path string")
    known = spark.createDataFrame([("0806_E5", 2), ("0119_E1", 1), ("", 0), ("0806_E5_mGFP_long_name", 0)], "specimen string, ord int")
    got = {r.path: r.specimen for r in catalog.find_specimen(paths, known).collect()}
    assert got == {"/data/0806_E5_mGFP.nii.gz": "0806_E5", "/x/20190806_E50.tif": "0806_E5", "/none/a.nii": None, "/two/0119_E1-0806_E5": "0119_E1", "E": None}
    assert {r.specimen for r in catalog.find_specimen(paths, known.limit(0)).collect()} == {None}


def test_a_long_catalog_is_not_sent_to_the_driver(spark):
    """Tables that are small as files, but hold many names, meet by key; names of many shapes are found as well."""
    named = spark.range(3000).selectExpr("concat('0', id, '_E', id % 3) AS specimen", "id AS ord")
    odd = spark.createDataFrame([("\U0001f600-7", -1), ("a.b", -2), ("a1", -4), (None, -3)], "specimen string, ord long")
    paths = spark.range(40).selectExpr("concat('/x0', id * 5, '_E', id % 2, CASE WHEN id % 7 = 0 THEN '\U0001f600-7' WHEN id % 11 = 0 THEN 'a.b' ELSE '' END) AS path")
    names, expected = [(r.specimen, r.ord) for r in named.unionByName(odd).collect() if r.specimen], {}
    for r in paths.collect():
        expected[r.path] = min(((o, s) for s, o in names if s in r.path), default=(None, None))[1]
    assert len({v is None for v in expected.values()}) == 2 and "a.b" in expected.values()
    for most in (500, 2):
        found = catalog.find_specimen(paths, named.unionByName(odd), most)
        assert {r.path: r.specimen for r in found.collect()} == expected
    plan = catalog.find_specimen(paths, named)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "BroadcastHashJoin [specimen" in line]


def test_paths_by_type_level_and_filter(spark):
    names = ["/d/Gr2/RawImages/Nuclei/b_0806_E5.nii.gz", "/d/Gr1/RawImages/Nuclei/z_0806_E5.nii.gz", "/d/Gr1/RawImages/Nuclei/a_0806_E5.h5", "/d/Gr1/RawImages/Nuclei/Filtered/0806_E5_f.nii.gz", "/d/Gr1/Features/0806_E5_nuclei.csv", "/d/other/0806_E5.txt"]
    asked = [("0806_E5", "Nuclei", "RawImages", False), ("0806_E5", "Nuclei", "RawImages", True), ("0806_E5", None, "Features", False), ("0806_E5", "Membrane", "RawImages", False)]
    got = catalog.resolve_path(
        spark.createDataFrame(asked, "specimen string, level string, type string, filtered boolean"), spark.createDataFrame([(n,) for n in names], "path string"), spark.createDataFrame([("Gr1", 1), ("Gr2", 2)], "group string, ord int")
    )
    found = {(r.level, r.type, r.filtered): r.path for r in got.collect()}
    assert found == {("Nuclei", "RawImages", False): names[1], ("Nuclei", "RawImages", True): names[3], (None, "Features", False): names[4], ("Membrane", "RawImages", False): None}


def test_volumes_are_written_by_slabs_and_keep_their_place(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(s, int(x), int(y), int(z), float(v)) for s in (1, 2) for x, y, z, v in zip(rng.integers(3, 9, 60), rng.integers(5, 8, 60), rng.integers(100, 140, 60), rng.random(60))]
    rows = list({r[:4]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "specimen long, x long, y long, z long, intensity double")
    done = files.write_nifti(df, "specimen", f"file://{tmp_path}/v", (0.5, 0.5, 2.0), slab_bytes=2000).collect()
    assert {r.specimen for r in done} == {1, 2} and all((tmp_path / "v" / f"volume_{r.specimen}.nii.gz").stat().st_size == r.bytes for r in done)
    back = files.read_nifti(spark, f"{tmp_path}/v/*.nii.gz", placed=True).filter("intensity <> 0").collect()
    assert {(int(r.path[-8]), r.x, r.y, r.z, r.intensity) for r in back} == set(rows)
    raw = (tmp_path / "v" / "volume_1.nii.gz").read_bytes()
    assert files.nifti_header(gzip.decompress(raw))["origin"] == [min(r[k] for r in rows if r[0] == 1) for k in (1, 2, 3)]
    (tmp_path / "v" / "volume_1.nii.gz").write_bytes(raw[: len(raw) // 2])
    with pytest.raises(Exception, match="cut off"):
        files.read_nifti(spark, f"{tmp_path}/v/volume_1.nii.gz").count()


def test_stored_volumes_have_their_metadata(spark, tmp_path):
    df = spark.createDataFrame([(1, "Nuclei", 0, 0, 0, 2.0), (2, "Nuclei", 1, 0, 0, 3.0)], "specimen long, level string, x long, y long, z long, intensity double")
    meta = spark.createDataFrame([(1, "Nuclei", 9, 0.5), (2, "Nuclei", 8, 0.4)], "specimen long, level string, x_size int, x_res double")
    files.write_volume(df, meta, f"{tmp_path}/s", ["specimen", "level"])
    voxels, known = files.read_stored(spark, f"{tmp_path}/s")
    assert sorted((r.specimen, r.intensity, r.x_size) for r in voxels.join(known, ["specimen", "level"]).collect()) == [(1, 2.0, 9), (2, 3.0, 8)]


def test_hexadecimal_floats(spark):
    rng = np.random.default_rng(3)
    values = [0.0, 1.0, 0.5, 0.1, 1 / 3, 2.0**-30, 1 - 2.0**-53, 2 - 2.0**-52, 8 - 2.0**-50, 1e300, 5e-324, 2.0**-1022, -0.75, 123456.789, *rng.random(200).tolist(), *np.exp(rng.normal(0, 40, 200)).tolist()]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    from pyspark.sql import functions as F

    rows = df.select("v", files.to_hex(F.col("v")).alias("t")).select("v", "t", files.from_hex(F.col("t")).alias("back")).collect()
    assert all(r.back == r.v for r in rows) and all(float.fromhex(r.t) == r.v for r in rows if r.v is not None)
    other = spark.createDataFrame([(v.hex(), v) for v in values] + [("0x1p-2", 0.25), ("x", None), ("-0x0.8p+1", -1.0)], "t string, v double")
    assert all(r.b == r.v for r in other.select("v", files.from_hex(F.col("t")).alias("b")).collect())


def test_one_image_is_read_by_several_tasks_and_filters_skip_slabs(spark, tmp_path):
    """Plain, indexed and foreign gzip images: equal rows however they are cut, and only slabs that a box meets."""
    from tissueframe.sources import volumes

    volume = np.random.default_rng(2).integers(0, 9, (7, 5, 40)).astype("<i2")
    raw = files.nifti_bytes(volume, (0.5, 0.5, 1.0))
    flat = 7 * 5 * 2
    (tmp_path / "plain.nii").write_bytes(raw)
    (tmp_path / "foreign.nii.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "cut.nii.gz").write_bytes(b"".join(volumes.member(raw[(352 + k * flat if k else 0) : 352 + (k + 8) * flat], k, 8) for k in range(0, 40, 8)))
    assert gzip.decompress((tmp_path / "cut.nii.gz").read_bytes()) == raw
    want = {(x, y, z, float(volume[x, y, z])) for x in range(7) for y in range(5) for z in range(40)}
    for name, parts in (("plain.nii", 10), ("foreign.nii.gz", 1), ("cut.nii.gz", 5)):
        df = files.read_nifti(spark, f"{tmp_path}/{name}", part_bytes=4 * flat)
        assert df.rdd.getNumPartitions() == parts
        assert {tuple(r)[1:] for r in df.collect()} == want
        box = df.filter("z >= 9 AND z < 15 AND x > 2 AND y = 3 AND intensity > 4")
        assert {tuple(r)[1:] for r in box.collect()} == {v for v in want if 9 <= v[2] < 15 and v[0] > 2 and v[1] == 3 and v[3] > 4}
        assert box.rdd.getNumPartitions() <= (1 if parts == 1 else 3)
        assert files.read_nifti(spark, f"{tmp_path}/{name}").filter("z > 99").count() == 0
        swapped = files.read_nifti(spark, f"{tmp_path}/{name}", axes="ZYX", part_bytes=4 * flat).filter("x BETWEEN 38 AND 50")
        assert {tuple(r)[1:] for r in swapped.collect()} == {(z, y, x, v) for x, y, z, v in want if z >= 38}
    every = files.read_nifti(spark, str(tmp_path))
    assert every.count() == 3 * len(want) and every.filter(f"path = '{tmp_path}/cut.nii.gz' AND z = 0").count() == 35
    assert files.volume_metadata(spark, f"{tmp_path}/*.nii*").count() == 3


def test_slabs_are_committed_as_images(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = list({(s, int(x), int(y), int(z)): (s, int(x), int(y), int(z), float(v)) for s in (1, 2) for x, y, z, v in zip(rng.integers(3, 9, 60), rng.integers(5, 8, 60), rng.integers(-3, 40, 60), 1 + rng.random(60))}.values())
    df = spark.createDataFrame(rows, "specimen long, x long, y long, z long, intensity double")
    files.write_slabs(df, "specimen", f"file://{tmp_path}/v", slab_bytes=2000)
    names = sorted(p.name for p in (tmp_path / "v").iterdir())
    assert len(names) > 6 and all(n.startswith("volume_") for n in names)
    back = files.read_nifti(spark, f"file://{tmp_path}/v", placed=True).filter("intensity <> 0").collect()
    assert {(int(r.path.rsplit("volume_", 1)[1].split("_")[0]), r.x, r.y, r.z, r.intensity) for r in back} == set(rows)
    files.write_slabs(df.filter("specimen = 1"), "specimen", f"file://{tmp_path}/v", mode="overwrite")
    assert {n.name.split("_")[1] for n in (tmp_path / "v").iterdir()} == {"1"}


def test_writer_leaves_nothing_of_a_failed_attempt(spark, tmp_path):
    from pyspark.sql import functions as F

    from tissueframe.sources import volumes

    volumes.register(spark)
    bad = spark.range(0, 8, 1, 4).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") == 7, F.expr("cast(raise_error('stop') AS binary)")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("nifti").mode("append").save(f"file://{tmp_path}/w")
    assert not [p for p in tmp_path.glob("w/*") if not p.name.startswith(".")]


def test_one_mesh_is_written_and_read_by_several_tasks(spark, tmp_path):
    """Splits of a few hundred bytes: lines keep their numbers, whatever the cuts; headers of other writers are read."""
    n = 300
    v = spark.createDataFrame([(m, i, i / 8, -i / 4, float(m), i % 5) for m in (1, 2) for i in range(n)], "mesh int, vid long, x double, y double, z double, cell_id long")
    f = spark.createDataFrame([(1, i, i, i + 1, i + 2, i % 5) for i in range(n - 2)], "mesh int, fid long, v0 long, v1 long, v2 long, cell_id long")
    files.write_ply(v, f, "mesh", f"{tmp_path}/w")
    parts = sorted((tmp_path / "w" / "mesh=1").glob("part-*"))
    assert parts[0].read_text().startswith("ply\nformat ascii 1.0\nelement vertex 300\n")
    (tmp_path / "one.ply").write_text("".join(p.read_text() for p in parts).replace("property double z\n", "property double z\ncomment end_header is below\nproperty float q\n"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        for path, folders in ((f"{tmp_path}/one.ply", False), (f"{tmp_path}/w/mesh=1", True)):
            gv, gf = files.read_ply(spark, path, folders)
            assert sorted(tuple(r)[1:] for r in gv.collect()) == [(i, i / 8, -i / 4, 1.0, i % 5) for i in range(n)]
            assert sorted(tuple(r)[1:] for r in gf.collect()) == [(i, i, i + 1, i + 2, i % 5) for i in range(n - 2)]
        assert spark.read.text(f"{tmp_path}/one.ply").rdd.getNumPartitions() > 10
        gv, gf = files.read_ply(spark, f"{tmp_path}/w/mesh=2", True)
        assert gv.count() == n and gf.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_package_as_archive(tmp_path):
    """What executors of a cluster get is the whole package, importable from the archive alone."""
    import subprocess
    import sys
    from pathlib import Path

    import tissueframe
    from tissueframe.workspace import package

    path = package(Path(tissueframe.__file__).parent, str(tmp_path))
    code = "import sys; sys.path.insert(0, sys.argv[1]); import tissueframe.operators.cohort as c, tissueframe.sources.files; print(c.__file__)"
    got = subprocess.run([sys.executable, "-c", code, path], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert path in got.stdout, got.stderr
