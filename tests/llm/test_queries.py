"""Every registered query of the text operators on the smallest tables, and those with SQL against it."""

import os

import duckdb
import pytest

from tissueframe.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents benchmark labels conversations embeddings".split()
#: What the contracts name; further columns may follow.
COLUMNS = {
    "op1": "doc_id n_tokens ids_sha256 decoded_sha256", "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op5": "doc_id item_id", "op6": "doc_id held_out lang_pred score", "op7": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op8": "doc_id n_shingles component_id kept", "op9": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op10": "doc_id held_out score predicted",
    "op11": "item_id rank doc_id score", "op12": "vec_id n_links component_id kept", "op13": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    wanted = COLUMNS.get(name.split("_")[0], "").split()
    assert df.columns[: len(wanted)] == wanted
    if name.split("_")[0] not in ("op4", "op5", "op7", "op11", "op12", "op13"):
        docs = duck.sql("SELECT doc_id FROM documents").fetchall()
        assert sorted(r[:1] for r in got) == sorted(docs)
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(got, key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
