"""Stages that run only for specimens whose output is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import missing_outputs
from ..workspace import Workspace


def todo(catalog: DataFrame, inputs: DataFrame, path: str, key: str = "specimen") -> DataFrame:
    """Keys of the catalog with an input and no partition below ``path``."""
    spark = catalog.sparkSession
    try:
        done = spark.read.parquet(path).select(F.col(key).cast(catalog.schema[key].dataType).alias(key)).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = catalog.select(key).limit(0)
    return missing_outputs(catalog.select(key), inputs, done, key)


def incremental(catalog: DataFrame, inputs: DataFrame, path: str, stage: Callable[[DataFrame], DataFrame], key: str = "specimen") -> DataFrame:
    """Applies ``stage`` to the inputs of the missing keys and adds their partitions; those there are stay. What is missing
    is found out before the first file is written."""
    work = Workspace(catalog.sparkSession)
    rest = inputs.join(work.write(todo(catalog, inputs, path, key)), key, "left_semi")
    stage(rest).write.mode("append").partitionBy(key).parquet(path)
    return catalog.sparkSession.read.parquet(path)
