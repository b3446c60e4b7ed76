"""File formats of imaging and meshes: NIfTI volumes, text PLY, surface maps, landmarks, training histories, CSV tables.

Images come through the data source of ``volumes``, or through Spark's own binaryFile source from a store that only Spark
opens; text goes through the text source and stays in columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace, ship
from . import volumes
from .nifti import HEAD, nifti_bytes, nifti_head, nifti_header, unpacked

__all__ = ["nifti_bytes", "nifti_head", "nifti_header"]

# --- NIfTI -----------------------------------------------------------------------------------------

def read_nifti(spark: SparkSession, path: str, axes: str = "XYZ", placed: bool = False, part_bytes: int = volumes.PART_BYTES) -> DataFrame:
    """``path, x, y, z, intensity`` of every voxel of the images under a path or glob; of 4-D images the first channel.
    ``axes`` names the logical axis that each stored one holds. Voxels count from 0, or, if ``placed``, from the place of
    the first one by the affine. Tasks read slabs of ``part_bytes`` by byte ranges, and filters on x, y, z and path reach
    them (see ``volumes``). From a store that only Spark's readers open, a file is one task's, slice by slice."""
    if volumes.reachable(path):
        volumes.register(spark)
        return spark.read.format("nifti").option("axes", axes).option("placed", str(placed)).option("partBytes", part_bytes).load(path)
    ship(spark)
    names = [a.lower() for a in axes]

    def one(content: bytes) -> Iterator[list[pa.Array]]:
        h = _header(content)
        nx, ny, nz, _ = h["shape"]
        file = pa.BufferReader(content)
        pieces, held = unpacked(file) if content[:2] == b"\x1f\x8b" else iter([content]), bytearray()

        def take(n: int) -> bytes:
            while len(held) < n:
                held.extend(next(pieces, b"") or _cut_off())
            out = bytes(held[:n])
            del held[:n]
            return out

        take(h["offset"])
        slab, (ox, oy, oz) = nx * ny, h["origin"] if placed else (0, 0, 0)
        grid = {names[0]: np.tile(np.arange(nx), ny) + ox, names[1]: np.repeat(np.arange(ny), nx) + oy}
        for k in range(nz):
            data = np.frombuffer(take(slab * h["dtype"].itemsize), h["dtype"]).astype(float) * h["slope"] + h["inter"]
            cols = grid | {names[2]: np.full(slab, k + oz)}
            yield [*(pa.array(cols[a].astype(np.int64)) for a in "xyz"), pa.array(data)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column("path"), batch.column("content")):
                for arrays in one(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([where.as_py()] * len(arrays[0])), *arrays], ["path", "x", "y", "z", "intensity"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, x long, y long, z long, intensity double")


def _cut_off() -> bytes:
    raise ValueError("the image is cut off")


def _header(content: bytes) -> dict:
    return nifti_header(zlib.decompressobj(31).decompress(content, HEAD) if content[:2] == b"\x1f\x8b" else content)


def volume_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sizes, spacing and affine from the headers alone: the first bytes of each file are read, and no samples. (From a
    store that only Spark's readers open, whole files are.)"""
    if volumes.reachable(path):
        volumes.register(spark)
        return spark.read.format("nifti_header").load(path)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_header(c) for c in batch.column("content").to_pylist()]
            size = [pa.array([h["shape"][k] for h in rows], pa.int32()) for k in range(3)]
            res = [pa.array([h["spacing"][k] for h in rows], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *size, *res, pa.array([h["affine"] for h in rows], pa.list_(pa.list_(pa.float64())))], ["path", "x_size", "y_size", "z_size", "x_res", "y_res", "z_res", "affine"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, x_size int, y_size int, z_size int, x_res double, y_res double, z_res double, affine array<array<double>>")


def _packed(df: DataFrame, by: str, spacing: tuple[float, float, float], value: str, slab_bytes: int, alone: bool) -> DataFrame:
    """``by, k, first, member``: slabs of about ``slab_bytes`` as gzip members; an image of its own each if ``alone``."""
    ship(df.sparkSession)
    ends = df.groupBy(by).agg(*[F.min(a).cast("long").alias(f"_o{a}") for a in "xyz"], *[(F.max(a) - F.min(a) + 1).cast("long").alias(f"_n{a}") for a in "xyz"])
    ends = ends.withColumn("_d", F.greatest(F.lit(1), F.floor(F.lit(slab_bytes) / (8 * F.col("_nx") * F.col("_ny")))))
    size = [f"_{k}{a}" for k in "on" for a in "xyz"] + ["_d"]
    # Every slab has a row that tells its frame, so that one of zeros is written too; voxels carry a place and a value.
    frame = ends.select(by, F.explode(F.expr("sequence(0L, (_nz - 1) div _d)")).alias("_k"), F.lit(None).cast("long").alias("_p"), F.lit(None).cast("double").alias("_v"), F.concat_ws(",", *size).alias("_f"))
    rows = df.select(by, *[F.col(a).cast("long").alias(a) for a in "xyz"], F.col(value).cast("double").alias("_v")).join(ends, by).withColumn("_k", F.expr("(z - _oz) div _d"))
    rows = rows.select(by, "_k", F.expr("((z - _oz - _k * _d) * _ny + y - _oy) * _nx + x - _ox").alias("_p"), "_v", F.lit(None).cast("string").alias("_f"))
    kind = df.schema[by].dataType.simpleString()

    def pack(group: pa.Table) -> pa.Table:
        whole = pc.equal(group.column("_p").is_valid(), False)
        ox, oy, oz, nx, ny, nz, d = map(int, group.filter(whole).column("_f")[0].as_py().split(","))
        own = group.filter(pc.invert(whole))
        k = group.column("_k")[0].as_py()
        deep = min(d, nz - k * d)
        slab = np.zeros(nx * ny * deep, "<f8")
        slab[own.column("_p").to_numpy()] = own.column("_v").to_numpy()
        shape, place = ((nx, ny, deep), oz + k * d) if alone else ((nx, ny, nz), oz)
        head = nifti_head(shape, "f8", spacing, (ox, oy, place)) if alone or k == 0 else b""
        packed = volumes.member(head + slab.tobytes(), 0 if alone else k * d, deep)
        return pa.table({by: group.column(by).slice(0, 1), "k": [k], "first": [oz + k * d], "member": [packed]})

    return rows.unionByName(frame).groupBy(by, "_k").applyInArrow(pack, f"`{by}` {kind}, k long, first long, member binary")


def write_slabs(df: DataFrame, by: str, path: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), value: str = "intensity", slab_bytes: int = 32 << 20, mode: str = "append") -> None:
    """Each slab of each volume as an image of its own below ``path``, ``volume_<by>_z<first slice>.nii.gz``, whose affine
    tells its place: ``read_nifti(..., placed=True)`` of the folder gives the volumes again. Files appear with the commit."""
    volumes.register(df.sparkSession)
    slabs = _packed(df, by, spacing, value, slab_bytes, True)
    named = slabs.select(F.format_string("volume_%s_z%s.nii.gz", F.col(by).cast("string"), F.col("first").cast("string")).alias("name"), F.col("member").alias("content"))
    named.write.format("nifti").mode(mode).save(path)


def write_nifti(df: DataFrame, by: str, path: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), value: str = "intensity", slab_bytes: int = 32 << 20) -> DataFrame:
    """Each volume of ``df(by, x, y, z, value)`` as a file below ``path``, a folder that all executors reach; returns
    ``by, path, bytes``. The frame ends at the outermost voxels of each volume, 0 where there is none; the affine tells
    its place. Slabs of slices of about ``slab_bytes`` are packed side by side, each a gzip member; a task then appends
    a file's members one after the other, to a temporary name first, and holds one at a time."""
    kind = df.schema[by].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        name, part, out, n = None, None, None, 0
        attempt = TaskContext.get().taskAttemptId()

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(part, f"{base}/volume_{name}.nii.gz")
            return pa.RecordBatch.from_arrays([pa.array([name], arrow), pa.array([f"{path}/volume_{name}.nii.gz"]), pa.array([n])], [by, "path", "bytes"])

        for batch in batches:
            arrow = batch.schema.field(by).type
            for row in range(batch.num_rows):
                key, member = batch.column(by)[row].as_py(), batch.column("member")[row].as_buffer()
                if key != name or out is None:
                    if out is not None:
                        yield close()
                    name, n, part = key, 0, f"{base}/.volume_{key}-{attempt}"
                    out = fs.open_output_stream(part, compression=None)
                out.write(member)
                n += len(member)
        if out is not None:
            yield close()

    members = _packed(df, by, spacing, value, slab_bytes, False).select(by, "k", "member")
    return members.repartition(by).sortWithinPartitions(by, "k").mapInArrow(write, f"`{by}` {kind}, path string, bytes long")


def write_volume(df: DataFrame, metadata: DataFrame, path: str, by: list[str]) -> None:
    """Voxels below ``path``/voxels, partitioned by ``by``, and a row of metadata (sizes, resolutions, affine) for each
    volume in the sibling table ``path``/metadata. Rows go where they are; no volume passes one task."""
    df.write.partitionBy(*by).parquet(f"{path}/voxels")
    metadata.write.parquet(f"{path}/metadata")


def read_stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Voxels and metadata that ``write_volume`` stored; a filter on the keys reads their folders alone."""
    meta = spark.read.parquet(f"{path}/metadata")
    voxels = spark.read.parquet(f"{path}/voxels")
    kinds = {f.name: f.dataType for f in meta.schema}
    return voxels.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in voxels.columns]), meta


# --- PLY -------------------------------------------------------------------------------------------

#: Fixed value: the head of a text PLY with cells on vertices and faces.
PLY_HEAD = "ply\nformat ascii 1.0\nelement vertex %d\nproperty double x\nproperty double y\nproperty double z\nproperty int cell_id\nelement face %d\nproperty list uchar int vertex_indices\nproperty int cell_id\nend_header"


def ply_text(vertices: DataFrame, faces: DataFrame, by: str) -> DataFrame:
    """``by, content``: a text PLY of each mesh, with ``cell_id`` on vertices and faces. Vertices are numbered by place."""
    v = vertices.groupBy(by).agg(F.count("*").alias("nv"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vid", F.concat_ws(" ", "x", "y", "z", "cell_id").alias("t")))), lambda e: e["t"]), "\n").alias("tv"))
    f = faces.groupBy(by).agg(F.count("*").alias("nf"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fid", F.concat_ws(" ", F.lit("3"), "v0", "v1", "v2", "cell_id").alias("t")))), lambda e: e["t"]), "\n").alias("tf"))
    head = F.format_string(PLY_HEAD, "nv", "nf")
    return v.join(f, by).select(by, F.concat_ws("\n", head, "tv", "tf").alias("content"))


def write_ply(vertices: DataFrame, faces: DataFrame, by: str, path: str) -> None:
    """Text PLY of each mesh in the folder ``path``/``by``=<mesh>, as part files that follow one another by name: tasks
    write stretches of lines side by side. ``cat`` of a folder is a PLY file; ``read_ply(..., folders=True)`` reads it.
    Meshes without faces are written too."""
    v = vertices.select(by, F.lit(1).alias("part"), F.col("vid").cast("long").alias("at"), F.concat_ws(" ", "x", "y", "z", "cell_id").alias("value"))
    f = faces.select(by, F.lit(2).alias("part"), F.col("fid").cast("long").alias("at"), F.concat_ws(" ", F.lit("3"), "v0", "v1", "v2", "cell_id").alias("value"))
    sizes = v.unionByName(f).groupBy(by).agg(F.sum(F.expr("int(part = 1)")).alias("nv"), F.sum(F.expr("int(part = 2)")).alias("nf"))
    head = F.format_string(PLY_HEAD, "nv", "nf")
    lines = sizes.select(by, F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), head.alias("value")).unionByName(v).unionByName(f)
    lines.repartitionByRange(by, "part", "at").sortWithinPartitions(by, "part", "at").select(by, "value").write.partitionBy(by).text(path)


def numbered_lines(spark: SparkSession, path: str, folders: bool = False, work: Workspace | None = None) -> DataFrame:
    """``path, line, value``: the lines of text files numbered from 0, of any length: splits of a file are read side by
    side, and a split's lines go on from those of the splits before it. With ``folders``, the files of a folder are one
    text in the order of their names, and ``path`` is the folder."""
    work = work or Workspace(spark)
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), "value")
    rows = work.write(rows.withColumn("__at", F.monotonically_increasing_id()))
    name = F.regexp_replace("__file", "/[^/]*$", "") if folders else F.col("__file")
    # A row for each split of each file.
    splits = rows.groupBy("__file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).withColumn("path", name)
    before = F.sum("__n").over(W.partitionBy("path").orderBy("__file", "__start")) - F.col("__n")
    splits = splits.select("path", "__file", "__start", "__first", before.alias("__before"))
    return rows.join(splits, ["__file", "__start"]).select("path", (F.col("__before") + F.col("__at") - F.col("__first")).alias("line"), "value")


def read_ply(spark: SparkSession, path: str, folders: bool = False, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """``vertices(path, vid, x, y, z, cell_id)`` and ``faces(path, fid, v0, v1, v2, cell_id)`` of text PLY files whose
    vertices start with x, y, z and end with cell_id; properties between are skipped. Several tasks read one mesh."""
    lines = numbered_lines(spark, path, folders, work)
    number = lambda what: F.max(F.when(F.col("line") < F.col("__end"), F.regexp_extract("value", rf"^element {what} (\d+)", 1).try_cast("long")))
    ends = lines.filter("trim(value) = 'end_header'").groupBy("path").agg(F.min("line").alias("__end"))
    head = lines.join(ends, "path").filter("line < __end").groupBy("path", "__end").agg(number("vertex").alias("nv"), number("face").alias("nf"))
    body = lines.join(head, "path").filter("line > __end").select("path", "nv", F.coalesce("nf", F.lit(0)).alias("nf"), (F.col("line") - F.col("__end") - 1).alias("at"), F.split(F.trim("value"), r"\s+").alias("w"))
    w = lambda i, kind: F.element_at("w", i).cast(kind)
    v = body.filter("at < nv").select("path", F.col("at").alias("vid"), *[w(i + 1, "double").alias(a) for i, a in enumerate("xyz")], w(-1, "long").alias("cell_id"))
    f = body.filter("at >= nv AND at < nv + nf").select("path", (F.col("at") - F.col("nv")).alias("fid"), *[w(i + 2, "long").alias(f"v{i}") for i in range(3)], w(-1, "long").alias("cell_id"))
    return v, f


# --- surface maps, landmarks, histories, tables ----------------------------------------------------

#: Fixed value: a hexadecimal float, sign, whole digit, fraction and exponent.
HEX = r"^(-?)0x([0-9a-fA-F]+)\.?([0-9a-fA-F]*)p([+-]?[0-9]+)$"


def from_hex(text: Column) -> Column:
    """The double of a hexadecimal float; null for anything else. All 53 bits of the digits fit a long."""
    part = lambda i: F.regexp_extract(text, HEX, i)
    digits = F.conv(F.concat(part(2), part(3)), 16, 10).cast("double")
    value = digits * F.pow(F.lit(2.0), part(4).cast("int") - 4 * F.length(part(3)))
    return F.when(text.rlike(HEX), F.when(part(1) == "-", -value).otherwise(value))


def to_hex(value: Column) -> Column:
    """A finite double as a hexadecimal float with 13 digits after the point; null stays null."""
    two, size = F.lit(2.0), F.abs(value)
    guess = F.floor(F.log2(F.greatest(size, F.lit(2.0**-1022)))).cast("int")
    # The logarithm of a value next to a power of two may round over it.
    power = F.when(size / F.pow(two, guess) >= 2, guess + 1).when((size / F.pow(two, guess) < 1) & (guess > -1022), guess - 1).otherwise(guess)
    lead = F.when(size < 2.0**-1022, F.lit(0)).otherwise(F.lit(1))
    rest = ((size / F.pow(two, power) - lead) * F.lit(float(1 << 52))).cast("long")
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.lit("0x"), lead.cast("string"), F.lit("."), F.lpad(F.lower(F.hex(rest)), 13, "0"), F.lit("p"), F.when(power >= 0, "+").otherwise(""), power.cast("string"))
    return F.when(value == 0, "0x0.0p+0").otherwise(text)


def surface_map_lines(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.concat_ws(" ", F.lit("p"), "src_vertex", "c_vertex", "a_vertex", to_hex(F.col("alpha")), to_hex(F.col("beta"))).alias("value"))


def read_surface_map(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``p source c a alpha beta`` with weights as hexadecimal floats; gamma is what they lack to 1. Other lines are
    passed over."""
    w = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.col("value").startswith("p ")).select(F.input_file_name().alias("path"), w.alias("w"))
    out = rows.select("path", *[F.col("w")[i + 1].cast("long").alias(n) for i, n in enumerate(("src_vertex", "c_vertex", "a_vertex"))], from_hex(F.col("w")[4]).alias("alpha"), from_hex(F.col("w")[5]).alias("beta"))
    return out.withColumn("gamma", 1 - F.col("alpha") - F.col("beta"))


def landmarks_from_json(docs: DataFrame) -> DataFrame:
    """``name, x, y, z`` from JSON objects of points, one a row in ``value``."""
    rows = docs.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("name", "p"))
    return rows.select("name", *[F.col("p")[i].alias(a) for i, a in enumerate("xyz")])


def history_best(docs: DataFrame) -> DataFrame:
    """The best validation AUC over all epochs, and the run that has it, of each model; runs that are null count only as
    runs. ``docs(model, value)`` holds JSON objects from run to metrics by epoch."""
    kind = "map<string,struct<loss:array<double>,auc:array<double>,val_loss:array<double>,val_auc:array<double>>>"
    runs = docs.select("model", F.explode(F.from_json("value", kind)).alias("config", "h")).withColumn("best", F.array_max("h.val_auc"))
    top = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best")).alias("o"), "config")))
    return runs.groupBy("model").agg(F.count("*").alias("runs"), F.count("best").alias("completed"), F.max("best").alias("best"), top["config"].alias("config"))


def write_features(df: DataFrame, path: str) -> None:
    """A feature table as CSV; centroids as text ``[x, y, z]``."""
    df.withColumn("centroids", F.format_string("[%d, %d, %d]", "cx", "cy", "cz")).drop("cx", "cy", "cz").write.option("header", True).csv(path)


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A feature table with declared columns; the centroid as a struct, NaN as null, a legacy id column renamed."""
    df = spark.read.csv(path, header=True, schema=schema)
    if "original_labels" in df.columns and "cell_id" not in df.columns:
        df = df.withColumnRenamed("original_labels", "cell_id")
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    if "centroids" in df.columns:
        p = F.from_json("centroids", "array<int>")
        df = df.withColumn("centroid", F.struct(p[0].alias("x"), p[1].alias("y"), p[2].alias("z"))).drop("centroids")
    return df
