"""Written intermediates in the folder that all executors share; each cuts the lineage of an iteration."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach: spark.checkpoint.dir. Where it is unset, a session of one machine (a local
    master) gets a folder of its own; on a cluster that would lose data, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers. Workers of the driver's machine (any local master) import it from
    the driver's checkout; a cluster's executors get it as a zip archive, once an application."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.master.startswith("local"):
        env, own = sc.environment, str(root.parent)
        if own not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (own, env.get("PYTHONPATH", "")) if x)
    elif sc.applicationId not in _SHIPPED:
        sc.addPyFile(package(root, tempfile.mkdtemp(prefix="tissueframe-")))
        _SHIPPED.add(sc.applicationId)


def package(root: Path, folder: str) -> str:
    """The package as a zip archive in a folder of the driver, which Spark sends to executors from there."""
    path = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside give their shuffle files back when they end; else these stay until the driver happens to collect
    its garbage. For queries that run once: another run of the same frame shuffles anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: A written table of more rows is dealt by key in joins.
MANY_ROWS = 100_000


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, dealt by key in the join above it, as the other side is. Spark takes a written table for as large as its
    compressed files, a tenth or less of what its rows are in memory, and would send it whole through the driver. With
    ``rows``, their known number, only a table of more than ``MANY_ROWS``."""
    return df if rows is not None and rows <= MANY_ROWS else df.hint("merge")


_FOLDERS: list[str] = []
_TABLES: list[str] = []


def clean(spark: SparkSession) -> None:
    """Deletes the folders of all workspaces so far. Results are lazy and may read them, so this is the caller's to
    call, once results are written or collected."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _FOLDERS:
        delete(spark, _FOLDERS.pop())


class Workspace:
    """A folder of written tables. ``drop`` deletes tables that no later plan reads, ``clean`` what is left."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}"
        self.written: list[tuple[DataFrame, str]] = []
        _FOLDERS.append(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        """``df`` as a written table, read again."""
        path = self.path(str(len(self.written) + 1))
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((out, path))
        return out

    def bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """``df`` as a written table laid out by a key: joins on it shuffle the other side alone."""
        path, name = self.path(str(len(self.written) + 1)), f"work_{uuid.uuid4().hex}"
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        self.written.append((out, path))
        _TABLES.append(name)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables, named by what ``write`` returned."""
        for df in frames:
            for out, path in self.written:
                if out is df:
                    delete(self.spark, path)
