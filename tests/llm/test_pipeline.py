import hashlib
import random
import re

import pytest

from tissueframe.llm import pii

from .brute import groups, leaks

pipeline = pytest.importorskip("corpus_pipeline")


def test_equals_the_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(12)
    vocab = {"en": "the of and thing with which should over house green".split(), "fr": "le été où garçon être pour maison verte avec".split()}
    bench = [(i, " ".join(rng.choices(vocab["en"], k=20))) for i in range(3)]
    rows = []
    for i in range(80):
        lang = rng.choice(["en", "fr"])
        t = rng.choices(vocab[lang], k=rng.randint(5, 60))
        if i % 7 == 0:
            t.append("call +1 (212) 555-0147 or a@b.org")
        if i % 11 == 0:
            t.append(bench[i % 3][1])
        if rows and i % 5 == 0:
            t = rng.choice(rows)[1].split(" ")
        rows.append((i, " ".join(t), rng.choice([lang, lang, None]), f"s{i % 3}"))
    rows += [(200, None, "en", None), (201, "", None, "s"), (202, "12 34", "en", "s"), (203, "étés " * 9000, "fr", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(d, t) for d, t, _, _ in rows if re.search(r"[^\W\d_]", t or "")]
    comp = groups(left, 5, 80)
    left = [(d, t) for d, t in left if comp[d][1] == d]
    gone = {d for d, _ in leaks(left, bench)}
    want = {}
    for d, t in left:
        if d not in gone:
            for a, kind, b in reversed(pii.all_spans(t, pii.fitted())[1]):
                t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
            want[d] = (len(t), hashlib.sha256(t.encode()).hexdigest())
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_chars, r.text_sha256) for r in got} == want and len(got) == len(want)
    assert all(r.text_sha256 == r.decoded_sha256 and r.n_tokens == len(r.ids) and r.lang for r in got)
    assert {c for _, c in comp.values()} != set(comp) and gone


def written(spark, path, rows, bench, extra=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (extra(docs) if extra else docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    written(spark, f"{tmp_path}/a", [], [(1, "a b c d e f")])
    assert pipeline.run(spark, f"{tmp_path}/a").count() == 0
    rows = [(i, f"some words of text number {i} which differ by words like {i * i} and {i + 7} or {i * 3}", "en", "s", 9) for i in range(12)]
    written(spark, f"{tmp_path}/b", rows, [])
    assert sorted(r.doc_id for r in pipeline.run(spark, f"{tmp_path}/b").collect()) == list(range(12))


def test_null_and_repeated_keys_and_clashing_columns(spark, tmp_path):
    """Columns named like the stages' own keep the caller's values; every stage but the last returns all columns."""
    from pyspark.sql import functions as F

    rng = random.Random(31)
    text = lambda: " ".join(rng.choices("the of and thing with which should over house green field river stone".split(), k=40))
    rows = [(i, text(), "en", "s", 9) for i in range(20)]
    copy = rows[3][1]
    rows += [(None, text(), "en", "s", 9), (None, copy, "en", "s", 9), (7, text(), "en", "s", 9), (50, copy, "en", "s", 9), (51, "write to a@b.org or +1 (212) 555-0147 soon", None, "s", 9)]
    names = ["score", "lang_pred", "pii", "ids", "component_id", "kept", "n_shingles", "windows", "similarity", "item_id", "Bands", "label"]
    extra = lambda df: df.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    written(spark, tmp_path, rows, [(1, " ".join(rows[5][1].split()[:25]))], extra)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert all(r[n] == n + ("-" if r.doc_id is None else str(r.doc_id)) for r in docs.collect() for n in names)
    left = docs.collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted([i for i in range(20) if i != 5] + [7, 51])
    assert sum(r.doc_id is None for r in left) == 2
    assert {r.text for r in left if r.doc_id == 51} == {"write to [EMAIL] or [PHONE] soon"}
