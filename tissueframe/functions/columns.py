"""Scalar expressions of the analyses, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode_division(v: Column, missing_as_one: bool = False) -> Column:
    """0 where the class exceeds 1, else 1; null stays null, or becomes 1."""
    out = F.when(v.isNull(), None).when(v > 1, 0).otherwise(1)
    return F.coalesce(out, F.lit(1)) if missing_as_one else out


def columnarity(sphericity: Column, perpendicularity: Column) -> Column:
    return (1 - sphericity) * perpendicularity


def columnarity_parallel(sphericity: Column, perpendicularity: Column) -> Column:
    return (1 - sphericity) * (1 - perpendicularity)


def perpendicularity(angle: Column, sigma: float = 30.0) -> Column:
    """1 - exp(-(angle - 90)^2 / (2 sigma^2)), within 0 and 1."""
    value = 1 - F.exp(-(angle - 90) * (angle - 90) / (2 * sigma * sigma))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def vector_angle(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two vectors; the cosine is kept within -1 and 1."""
    dot = sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    norm = F.sqrt(sum((x * x for x in a), F.lit(0.0))) * F.sqrt(sum((x * x for x in b), F.lit(0.0)))
    return F.degrees(F.acos(F.greatest(F.least(dot / norm, F.lit(1.0)), F.lit(-1.0))))


def stage_number(group: Column) -> Column:
    return F.nullif(F.regexp_extract(group, r"(\d+)", 1), F.lit("")).cast("int")


def parse_point(text: Column) -> Column:
    """``[x, y, z]`` as a struct of integers."""
    parts = F.from_json(text, "array<int>")
    return F.struct(parts[0].alias("x"), parts[1].alias("y"), parts[2].alias("z"))


def parse_neighbors(text: Column) -> Column:
    """Numbers apart by white space, in brackets, as an array."""
    inner = F.trim(F.regexp_replace(text, r"[\[\]\s]+", " "))
    return F.when(inner == "", F.array().cast("array<bigint>")).otherwise(F.split(inner, " ").cast("array<bigint>"))


def argmax(values: Column) -> Column:
    """The place, from 0, of the first greatest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def image_name(number: Column, slice_: Column | None = None) -> Column:
    """Padded to three digits; longer numbers stay whole."""
    text = number.cast("string")
    padded = F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)
    return F.concat(padded, *([F.lit("_"), slice_.cast("string")] if slice_ is not None else []), F.lit(".tif"))


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)
