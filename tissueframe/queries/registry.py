"""Queries by name: a Spark function of the fixtures, and the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Data, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False) -> Callable:
    """Registers a function of ``Data`` under a name."""

    def put(fn: Callable[[Data], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql, recursive)
        return fn

    return put


def eigen_sql(source: str, key: str, cov: str = "covar_pop", least: int = 1) -> str:
    """Three common table expressions that end in ``eig``: ``key``, n, the six moments of x, y, z in ``source``, and the
    eigenvalues e1 >= e2 >= e3 of their matrix."""
    pairs = [a + b for i, a in enumerate("xyz") for b in "xyz"[i:]]
    moments = ", ".join(f"{cov}({p[0]}, {p[1]}) AS {p}" for p in pairs)
    square = "(xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz)"
    det = "(xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)"
    return f"""mom AS (SELECT *, (xx+yy+zz)/3 AS q FROM (SELECT {key}, count(*) AS n, {moments} FROM {source} GROUP BY {key} HAVING count(*) >= {least}) m),
ang AS (SELECT *, CASE WHEN p <= 1e-12*greatest(abs(q), 1e-30) THEN NULL ELSE acos(greatest(least(({det})/(2*p*p*p), 1e0), -1e0))/3 END AS a FROM (SELECT *, sqrt(greatest(({square})/6, 0e0)) AS p FROM mom) t),
eig AS (SELECT *, coalesce(q + 2*p*cos(a), q) AS e1, coalesce(q + 2*p*cos(a + 2*pi()/3), q) AS e3, 3*q - coalesce(q + 2*p*cos(a), q) - coalesce(q + 2*p*cos(a + 2*pi()/3), q) AS e2 FROM ang)"""
