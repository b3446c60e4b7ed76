"""Voxels, cells, meshes, maps and predictions derived from the driver's tables, in SQL that Spark and DuckDB share.

``E(i)`` stands for element i of ``embedding``, which the two engines spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()

FIXTURES = {
    "fx_catalog": """SELECT c_custkey AS specimen, c_nationkey % 10 + 1 AS group_no,
       concat('Gr', CAST(c_nationkey % 10 + 1 AS VARCHAR(10))) AS stage, c_custkey % 5 <> 0 AS to_analyze FROM customer""",
    "fx_volume": """SELECT k, specimen, x, y, z, intensity,
  CASE WHEN x % 5 = 4 OR y % 5 = 4 THEN 0
       WHEN x < 4 AND y >= 20 THEN CASE WHEN z % 24 < 3 THEN 80000 + 2*CAST(floor(z/24) AS BIGINT)
                                        WHEN z % 24 < 20 THEN 80001 + 2*CAST(floor(z/24) AS BIGINT) ELSE 0 END
       ELSE 1 + CAST(floor(x/5) AS BIGINT) + 5*CAST(floor(y/5) AS BIGINT) + 25*CAST(floor(z/6) AS BIGINT) END AS pred,
  CASE WHEN x % 5 = 4 AND y = x THEN 70000 + x + 25*CAST(floor(z/6) AS BIGINT)
       WHEN x < 4 AND y BETWEEN 20 AND 23 THEN CASE WHEN z % 24 < 9 THEN 90000 + 2*CAST(floor(z/24) AS BIGINT)
                                        WHEN z % 24 < 20 THEN 90001 + 2*CAST(floor(z/24) AS BIGINT) ELSE 0 END
       WHEN (x+1) % 6 = 5 OR y % 5 = 4 OR z % 12 = 11 THEN 0
       WHEN y < 10 THEN 1 + CAST(floor((x+1)/6) AS BIGINT) + 5*CAST(floor(y/5) AS BIGINT) + 25*CAST(floor(z/6) AS BIGINT)
       WHEN y < 15 THEN 1 + CAST(floor((x+1)/6) AS BIGINT) + 5*CAST(floor(y/5) AS BIGINT) + 25*CAST(floor(z/12) AS BIGINT) + 20000
       WHEN y < 20 THEN 40000 + CAST(floor(x/10) AS BIGINT) + 25*CAST(floor(z/3) AS BIGINT)
       WHEN x < 12 THEN 0
       ELSE 60000 + CAST(floor(x/5) AS BIGINT) + 25*CAST(floor(z/3) AS BIGINT) END AS gt,
  CASE WHEN x < 10 THEN 1 WHEN x < 18 THEN 5 ELSE 0 END AS tissue
FROM (SELECT o_orderkey AS k, o_orderkey % 25 AS x, CAST(floor(o_orderkey/25) AS BIGINT) % 25 AS y,
             CAST(floor(o_orderkey/625) AS BIGINT) AS z, CAST(floor(o_orderkey/7500) AS BIGINT) AS specimen,
             o_totalprice AS intensity FROM orders) g""",
    "fx_cells": """SELECT o_orderkey AS cell_id, o_custkey AS specimen,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Nuclei' ELSE 'Membrane' END AS level, o_totalprice AS volume,
       (o_orderkey % 97) / 96e0 AS sphericity, (o_orderkey % 89) / 88e0 AS perpendicularity,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 3 END AS cell_division FROM orders""",
    "fx_vertices": """SELECT p_partkey AS vid, p_partkey % 40 AS gx, CAST(floor(p_partkey/40) AS BIGINT) AS gy,
       10e0*(p_partkey % 40) AS x, 10e0*floor(p_partkey/40) AS y, p_size*2e-1 AS z,
       CAST(floor((p_partkey % 40)/8) AS BIGINT) + 5*CAST(floor(floor(p_partkey/40)/8) AS BIGINT) AS cell_id FROM part""",
    "fx_faces": """SELECT 2*a.vid AS fid, a.vid AS v0, b.vid AS v1, c.vid AS v2, a.cell_id
FROM fx_vertices a JOIN fx_vertices b ON b.gx = a.gx+1 AND b.gy = a.gy JOIN fx_vertices c ON c.gx = a.gx AND c.gy = a.gy+1
UNION ALL
SELECT 2*a.vid+1, b.vid, d.vid, c.vid, a.cell_id
FROM fx_vertices a JOIN fx_vertices b ON b.gx = a.gx+1 AND b.gy = a.gy JOIN fx_vertices c ON c.gx = a.gx AND c.gy = a.gy+1
                   JOIN fx_vertices d ON d.gx = a.gx+1 AND d.gy = a.gy+1""",
    "fx_surface_map": """SELECT s.specimen, v.vid AS src_vertex, v.vid AS c_vertex, v.vid + 1 AS a_vertex,
       5e-1 AS alpha, 25e-2 AS beta, 25e-2 AS gamma
FROM fx_vertices v CROSS JOIN (SELECT 1 AS specimen UNION ALL SELECT 2 UNION ALL SELECT 3) s WHERE v.gx < 39""",
    "fx_pred": """SELECT CAST(floor(vec_id/5) AS BIGINT) AS id, vec_id % 5 AS slice, 10 + (vec_id*7) % 13 AS area,
       8*CAST(E(1) AS DOUBLE) AS z0, 8*CAST(E(2) AS DOUBLE) AS z1, 8*CAST(E(3) AS DOUBLE) AS z2,
       CAST(floor(vec_id/5) AS BIGINT) % 3 AS y_true FROM embeddings""",
    "fx_points": """SELECT vec_id AS pid, 100*CAST(E(1) AS DOUBLE) AS ax, 100*CAST(E(2) AS DOUBLE) AS ay, 100*CAST(E(3) AS DOUBLE) AS az,
       100*CAST(E(4) AS DOUBLE) AS bx, 100*CAST(E(5) AS DOUBLE) AS by_, 100*CAST(E(6) AS DOUBLE) AS bz FROM embeddings""",
    "fx_quality": """SELECT l_suppkey AS test_name, avg(l_discount)*10 AS dice, avg(l_tax)*10 AS jaccard, count(*) AS n_cells,
       100*avg(CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0e0 END) AS correct,
       100*avg(CASE WHEN l_returnflag = 'N' THEN 1e0 ELSE 0e0 END) AS missing,
       100*avg(CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 0e0 END) AS over_segmented FROM lineitem GROUP BY l_suppkey""",
    "fx_history": """SELECT event_type AS model, user_id AS config,
       CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS BIGINT) AS epoch, value/500 AS val_auc FROM events""",
    "fx_landmarks": """SELECT n_name AS name, n_nationkey AS ord, 10e0*((n_nationkey*7) % 40) + 3 AS x,
       10e0*((n_nationkey*3) % 5) + 2 AS y, 5e0 AS z FROM nation""",
}


def _needs(sql: str) -> list[str]:
    """Fixtures named in a statement, with those they need, each after its own needs."""
    out: list[str] = []
    for name in FIXTURES:
        if re.search(rf"\b{name}\b", sql):
            for x in [*_needs(FIXTURES[name]), name]:
                if x not in out:
                    out.append(x)
    return out


def oracle(sql: str, recursive: bool = False) -> str:
    """DuckDB SQL in which fixtures are common table expressions; ``sql`` may start with its own after WITH."""
    ctes = [f"{n} AS ({re.sub(r'E[(](\d)[)]', r'embedding[\1]', FIXTURES[n])})" for n in _needs(sql)]
    body = sql.strip()
    own = re.match(r"WITH\s+", body)
    if own:
        body = body[own.end() :]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + (",\n" if own else "\n") + body) if ctes else (head + body if own else body)


class Data:
    """The driver's tables and the fixtures as DataFrames: ``Data(spark, sf_dir).fx_volume``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            return self.sql(FIXTURES[name])
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, sql: str, **frames: DataFrame) -> DataFrame:
        """A statement over tables, fixtures and ``frames`` by name."""
        sql = re.sub(r"E[(](\d)[)]", r"element_at(embedding, \1)", sql)
        used = {}
        for n in [*FIXTURES, *TABLES, *frames]:
            new = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
            if new != sql:
                sql, used[n] = new, frames.get(n) if n in frames else getattr(self, n)
        return self.spark.sql(sql, **used)
