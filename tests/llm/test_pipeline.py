"""The pipeline, stage by stage, against plain Python."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowspark.llm import langid, pii
from flowspark.llm.queries import oracle_sql, queries, vocabulary_path
from tests.llm.test_corpus_operators import _links

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, given = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = given = stage(spark, given, SF).cache()
        if name != "encoding":
            assert given.columns == docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in steps["language_id"].collect()}
    assert kept == {i for i, t in text.items() if langid.bundles([t])[1][0]}
    least, _ = _links({i: text[i] for i in kept}, 80, 5)
    assert {r.doc_id for r in steps["near_dedup"].collect()} == set(least.values())
    clean = {r.doc_id: r.text for r in steps["private_data"].collect()}
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert all((clean[i] == text[i]) == (not spans[i]) for i in clean)
    mixture = [r.doc_id for r in steps["mixture"].collect()]
    assert set(mixture) == set(clean)
    tool = tokenizers.Tokenizer.from_file(vocabulary_path())
    want = sorted((i, hashlib.sha256(np.array(tool.encode(clean[i], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for i in mixture)
    assert sorted((r.doc_id, r.ids_sha256) for r in steps["encoding"].collect()) == want


def test_language_stage_rejects_by_cosine(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    n = docs.count()
    rng = random.Random(1)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(2000)) for _ in range(40)]
    noise += ["a" + "#%!&" * 5000, "Привет, как дела? Сегодня хорошая погода. " * 20, "12 34"]
    odd = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(noise)], docs.schema)
    kept = [r.doc_id for r in corpus_pipeline.language_id(spark, docs.union(odd), SF).collect()]
    assert len(kept) == n and max(kept) < 10**6
    unlabelled = docs.union(odd).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, SF).count() == n + len(noise) - 1


def _odd(spark):
    """The documents' columns and names that stages use themselves; nulls, empty and long texts, repeats, rows without ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    base = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(123).collect()
    *base, alone, apart, _ = base
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    rows += [rows[5], rows[5], (rows[6][0], apart.text, "en", "s", 1), (None, alone.text, None, None, None), (None, rows[8][1], "en", "s", 5)]
    rows += [(9001, None, "en", "s", None), (9002, "", None, "s", 0), (9003, "12 34 ...", "en", None, 9), (9004, "call 555-123-4567 or mail ann@example.com " + " ".join(r[1] for r in rows[20:80] if r[1]) * 3, "en", "s", None)]
    wide = spark.createDataFrame(rows, docs.schema)
    for name in ("digest", "c0", "k0", "mix", "stratum", "lang_pred", "class", "id", "_mix"):
        wide = wide.withColumn(name, F.lit(name))
    return wide


def test_stages_on_odd_rows(spark):
    docs = _odd(spark).cache()
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, SF).cache()
        if name == "encoding":
            assert out.count() == given.count()
            break
        assert out.columns == docs.columns
        assert out.select("digest", "c0", "_mix").distinct().collect() == [("digest", "c0", "_mix")]
        texts = [r.text for r in out.collect()]
        if name == "language_id":
            assert None not in texts and "" not in texts and "12 34 ..." not in texts and len(texts) == docs.count() - 3
        if name == "near_dedup":
            assert len(set(texts)) == len(texts) and {i for i, n in collections.Counter(r.doc_id for r in out.collect()).items() if n > 1} <= {None, docs.collect()[6].doc_id}
        if name == "private_data":
            [long] = [t for t in texts if t.startswith("call <LOCAL_PHONE> or mail <EMAIL> ")]
            assert len(long) > 50_000
        given = out


def test_stages_on_an_empty_table(spark):
    given = _odd(spark).where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, SF)
        assert out.count() == 0 and (name == "encoding" or out.columns == given.columns)
        given = out


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in queries()}
    assert names == {f"op{n}" for n in range(1, 11)}
    assert set(oracle_sql()) <= set(queries())
