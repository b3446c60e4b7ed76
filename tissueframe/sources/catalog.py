"""Specimens, files and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import dealt

#: Tissue codes of a reference volume.
TISSUES = {
    "background": 0, "myocardium": 1, "embryo": 2, "pocket": 3, "somatic": 4, "splanchnic": 5, "proximal": 6, "aorta": 7, "lumen": 8,
    "middle plane": 9, "keep dorsal open myo": 10, "keep dorsal open spl": 11, "notochord": 12,
}


def tissue_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in TISSUES.items()], "name string, code int")


def find_group(specimens: DataFrame, catalog: DataFrame) -> DataFrame:
    """The stage group of each specimen, null for unknown ones."""
    return specimens.join(catalog.select("specimen", "stage"), "specimen", "left")


#: So many shapes of names (names with all digits alike) rule pieces of paths out.
SHAPES = 500


def _shape(text: Column) -> Column:
    return F.translate(text, "123456789", "000000000")


def find_specimen(paths: DataFrame, catalog: DataFrame, most: int = SHAPES) -> DataFrame:
    """The first specimen of the catalog (by ``ord``) whose name occurs anywhere in a path; null for a path that holds
    none. The pieces of a path that are as long as a name meet the names by equality, dealt by key, so the catalog may be
    long. Names of numbered specimens are alike but for their digits: where they have no more than ``most`` shapes, these
    come to the driver and only pieces of such a shape are taken; else the distinct lengths of names come, and all pieces
    of a length are."""
    named = catalog.filter("specimen <> ''")
    shapes = sorted(r[0] for r in named.select(_shape(F.col("specimen"))).distinct().limit(most + 1).collect())
    if not shapes:
        return paths.withColumn("specimen", F.lit(None).cast("string"))
    few = len(shapes) <= most
    lengths = sorted({len(s) for s in shapes} if few else (r[0] for r in named.select(F.length("specimen")).distinct().collect()))

    def pieces(n: int) -> Column:
        at = F.expr(f"sequence(1, greatest(length(path) - {n - 1}, 1))")
        if few:
            own = [s for s in shapes if len(s) == n]
            at = F.filter(at, lambda i: F.substring(F.col("__shape"), i, F.lit(n)).isin(own))
        return F.transform(at, lambda i: F.substring(F.col("path"), i, F.lit(n)))

    parts = paths.select("path").distinct().withColumn("__shape", _shape(F.col("path")))
    parts = parts.select("path", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in lengths]))).alias("specimen"))
    hit = parts.join(dealt(catalog.select("specimen", "ord")), "specimen").groupBy("path").agg(F.min(F.struct("ord", "specimen"))["specimen"].alias("specimen"))
    return paths.join(hit, "path", "left")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path by name: ``path, specimen, level, kind, bytes``; names are ``specimen_level.kind``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda i: F.nullif(F.regexp_extract(name, r"^(.+)_([^_.]+)\.(.+)$", i), F.lit(""))
    return files.select("path", part(1).alias("specimen"), part(2).alias("level"), part(3).alias("kind"), "bytes")


#: Fixed value: how folders name what they hold, ``group/type/level/[Filtered/]name`` with the level left out where a
#: type has none.
LAYOUT = r"([^/]+)/(RawImages|Segmentation|Features|Meshes|Maps)/(?:([^/]+)/)?(Filtered/)?([^/]+)$"


def laid_out(paths: DataFrame) -> DataFrame:
    """``path, group, type, level, filtered, name`` of files in the folders of a data set; others don't occur."""
    part = lambda i: F.regexp_extract("path", LAYOUT, i)
    rows = paths.filter(F.col("path").rlike(LAYOUT))
    return rows.select("path", part(1).alias("group"), part(2).alias("type"), F.nullif(part(3), F.lit("")).alias("level"), (part(4) != "").alias("filtered"), part(5).alias("name"))


def resolve_path(requests: DataFrame, paths: DataFrame, groups: DataFrame) -> DataFrame:
    """The file of each ``requests(specimen, level, type, filtered)``: of those of its type, level and kind that have the
    specimen in their name, the first by order of ``groups(group, ord)`` and by name; ``.h5`` files don't count. A null
    level asks for a type without levels, or for a file that names no level; null where there is none."""
    names = laid_out(paths).filter(~F.col("name").endswith(".h5")).join(groups, "group")
    wanted = requests.select("specimen").distinct().withColumn("ord", F.lit(0))
    # Every specimen asked for that a name holds, not only the first one.
    lengths = sorted(r[0] for r in wanted.select(F.length("specimen")).filter("specimen <> ''").distinct().collect())
    if not lengths:
        return requests.withColumn("path", F.lit(None).cast("string"))
    pieces = F.concat(*[F.expr(f"transform(sequence(1, greatest(length(name) - {n - 1}, 1)), i -> substring(name, i, {n}))") for n in lengths])
    found = names.withColumn("specimen", F.explode(F.array_distinct(pieces))).join(wanted.select("specimen"), "specimen", "left_semi")
    r, f = requests.alias("r"), found.alias("f")
    same = (F.col("r.specimen") == F.col("f.specimen")) & (F.col("r.type") == F.col("f.type")) & F.col("r.level").eqNullSafe(F.col("f.level")) & (F.col("r.filtered") == F.col("f.filtered"))
    first = F.min(F.struct("f.ord", "f.name", "f.path"))["path"].alias("path")
    return r.join(f, same, "left").groupBy("r.specimen", "r.level", "r.type", "r.filtered").agg(first)


def list_inputs(files: DataFrame, kind: str, excluded: str = "h5") -> DataFrame:
    """One file for each specimen and level: the first by path."""
    rows = files.filter((F.col("kind") == kind) & (F.col("kind") != excluded))
    return rows.groupBy("specimen", "level").agg(F.min("path").alias("path"))


def missing_outputs(catalog: DataFrame, inputs: DataFrame, outputs: DataFrame, key: str = "specimen") -> DataFrame:
    """Specimens with an input and without an output."""
    return catalog.join(inputs, key, "left_semi").join(outputs, key, "left_anti")


def missing_attribute(features: DataFrame, attribute: str) -> DataFrame:
    """Specimens none of whose cells has a value for an attribute."""
    if attribute not in features.columns:
        return features.select("specimen").distinct()
    return features.groupBy("specimen").agg(F.count(attribute).alias("_n")).filter("_n = 0").select("specimen")
