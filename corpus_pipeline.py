"""From raw documents to token ids: language, near-duplicates, benchmark leaks, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept, and returns a DataFrame; ``run`` writes
each as Parquet in the cluster's shared folder and reads it again as the next one's ``docs``. All but the last return the
columns of ``documents``.

1. ``language`` drops texts in which no language can be told: null, or without a letter. A missing ``lang`` becomes the
   predicted one.
2. ``near_duplicates`` keeps one document, that with the least doc_id, of each group at a similarity of 0.8 or more on
   five-word shingles.
3. ``decontamination`` drops documents that hold a benchmark item at a similarity of 0.8 or more.
4. ``personal_data`` puts ``[KIND]`` in the place of personal data and counts ``n_chars`` anew.
5. ``byte_bpe`` encodes the texts and decodes the ids again; the two digests show that nothing is lost.

Rows with a null doc_id are kept by stages that tell documents apart by it; rows that share a doc_id are one document
there, and stay or go together. An empty table gives an empty result, an empty ``benchmark`` takes nothing away. Further
columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissueframe.llm import bpe, decontam, langid, neardup, pii
from tissueframe.llm.common import table
from tissueframe.llm.queries import RANKS
from tissueframe.workspace import Workspace

#: Names that begin so are the stages' own; columns of the caller keep theirs, whatever these are.
PRIVATE = "__pipeline_"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(~langid.held_out("doc_id", 5, 0)).select("doc_id", "text", "lang"))
    told = langid.predict(docs, model, names=(f"{PRIVATE}lang", f"{PRIVATE}score")).filter(f"{PRIVATE}lang <> 'und'")
    return told.withColumn("lang", F.coalesce("lang", f"{PRIVATE}lang")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, words=5, percent=80).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"), words=5, percent=80).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.find_and_redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(docs.select("doc_id", "lang", "source", "n_chars", "text", F.sha2("text", 256).alias("text_sha256")), RANKS)
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "text_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: The stages fit models, follow links and merge bytes, which SQL can't express; tests/llm/test_pipeline.py holds the
#: result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done, docs = docs, work.write(stage(spark, docs, sf_dir))
        work.drop(done)
    return docs
