"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import bpe, chat, decontam, langid, media, neardup, pii, prefix_trie, quality, ranked, token_count, token_output, vectors
from .common import table

RANKS, PIECES = path("byte_bpe_multi_50k.tiktoken"), path("piece_bpe_32k.model")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, RANKS)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    listed = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(pii, x -> x.base AND x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in pii.BASE_KINDS]
    base = F.sha2(F.expr(listed.format("filter(pii, x -> x.base)")), 256)
    added = [F.expr(f"cast(size(filter(pii, x -> NOT x.base AND x.kind = '{k}')) AS long)").alias(f"n_added_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, base.alias("base_sha256"), F.expr(listed.format("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), *added)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, PIECES).select("doc_id", "n_pretokens", "n_tokens")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_output.write_shards(table(spark, sf_dir, "documents"), RANKS)
    rows = token_output.read_shards(spark, folder)
    return rows.select("slot", "shard", F.col("key").alias("doc_id"), "number", "used", F.sha2("ids", 256).alias("ids_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), langid.held_out("doc_id", 5, 0)
    model = langid.fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "SELECT -1L conv_id, cast(turn AS long) turn, role, '</s>[INST] ok [/INST]' text FROM VALUES (0, 'user'), (1, 'assistant') t(turn, role)"
    return chat.digest_conversations(chat.format_turns(turns.unionByName(spark.sql(probe))))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.write_media(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    back = media.read_media(stored)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), langid.held_out("doc_id", 3, 1)
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "quality"))
    return quality.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = Workspace(spark).write(prefix_trie.positions(table(spark, sf_dir, "conversations")))
    size = turns.groupBy("conv").agg(F.max("pos").alias("size"))
    h = (F.crc32(F.col("conv").cast("string")) % 9).alias("h")
    convs = size.select("conv", h, F.expr("conv - conv % 5").alias("base"))
    convs = convs.join(size.select(F.col("conv").alias("base"), "size"), "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("taken"))
    heads = convs.join(turns.filter("pos <= 8").withColumnRenamed("conv", "base"), "base").filter("pos <= h").select(turns.columns)
    rest = turns.join(convs, "conv").filter("pos > h").withColumn("pos", F.expr("pos - h + taken")).select(turns.columns)
    return prefix_trie.prefix_trie(heads.unionByName(rest), convs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_personal_data": op2_personal_data,
    "op3_token_counts": op3_token_counts,
    "op4_token_shards": op4_token_shards,
    "op5_decontamination": op5_decontamination,
    "op6_language": op6_language,
    "op7_chat": op7_chat,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_media": op9_media,
    "op10_quality": op10_quality,
    "op11_ranked_search": op11_ranked_search,
    "op12_embeddings": op12_embeddings,
    "op13_prefix_trie": op13_prefix_trie,
}

#: What SQL can express; the others are tested against brute force, round trips or held-out rows in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op7_chat": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
CAST(sum(27 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars FROM t GROUP BY 1""",
    "op8_near_duplicates": r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT d.doc_id, count(s.sh) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT reach.node, l.v FROM reach JOIN l ON l.u = reach.seen)
SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id, n.doc_id = min(seen) AS kept FROM n JOIN reach ON reach.node = n.doc_id GROUP BY n.doc_id, n.n""",
    "op11_ranked_search": r"""WITH t AS (SELECT rowid AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
s AS (SELECT count(*) AS n, sum(len(w)) AS l FROM t WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM t), f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(s.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
x AS (SELECT item_id, r, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * f.n * s.n) // s.l)))) AS score FROM f JOIN q USING (term) JOIN w USING (term), s GROUP BY ALL),
y AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM y WHERE rank <= 20""",
    "op12_embeddings": r"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT reach.node, l.v FROM reach JOIN l ON l.u = reach.seen),
c AS (SELECT node, min(seen) AS least FROM reach GROUP BY 1), n AS (SELECT u, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.least AS component_id, vec_id = c.least AS kept FROM embeddings LEFT JOIN n ON n.u = vec_id JOIN c ON c.node = vec_id""",
    "op13_prefix_trie": r"""WITH RECURSIVE k AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, c - c % 5 AS base, max(pos) AS size, CAST(c AS VARCHAR) AS name FROM t GROUP BY c),
g AS (SELECT s.c, s.base, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))), lambda x, b: xor(x // 256, k.t[xor(x, b) % 256 + 1])), 4294967295) % 9 AS h FROM s, k),
r AS (SELECT g.c, t.pos, role, text FROM g JOIN t ON t.c = g.base AND t.pos <= g.h
UNION ALL SELECT g.c, t.pos - g.h + least(g.h, coalesce(b.size, 0)), role, text FROM g JOIN t ON t.c = g.c AND t.pos > g.h LEFT JOIN s b ON b.c = g.base),
p AS (SELECT c, pos, strlen(text) AS bytes, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY pos) AS key, pos = max(pos) OVER (PARTITION BY c) AS last FROM r),
n AS (SELECT len(key) AS d, key, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(bytes) AS saves, sha256(coalesce(string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends FROM p GROUP BY ALL
UNION ALL SELECT 0, [], min(g.c), count(*), 0, sha256(coalesce(string_agg(CASE WHEN q.c IS NULL THEN CAST(g.c AS VARCHAR) END, ',' ORDER BY g.c), '')) FROM g LEFT JOIN (SELECT DISTINCT c FROM p) q ON q.c = g.c HAVING count(*) > 0),
e AS (SELECT a.d, a.c, b.c AS parent, a.n, a.saves, a.ends FROM n a LEFT JOIN n b ON b.d = a.d - 1 AND b.key = a.key[:-2]),
f AS (SELECT e.*, coalesce(m.m, 0) AS m FROM e LEFT JOIN (SELECT d - 1 AS d, parent AS c, count(*) AS m FROM e GROUP BY ALL) m ON m.d = e.d AND m.c = e.c),
up AS (SELECT d, c, d AS td, c AS tc FROM f UNION ALL SELECT up.d, up.c, e.d - 1, e.parent FROM up JOIN e ON e.d = up.td AND e.c = up.tc WHERE e.parent IS NOT NULL),
z AS (SELECT up.td, up.tc, sum(CASE WHEN f.m = 0 THEN 1 ELSE 0 END) AS leaves, sum(f.saves) AS saved FROM up JOIN f ON f.d = up.d AND f.c = up.c GROUP BY ALL)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n AS n_convs, CAST(f.m AS BIGINT) AS n_children, CAST(z.leaves AS BIGINT) AS n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256 FROM f JOIN z ON z.td = f.d AND z.tc = f.c""",
}
