"""The queries of this subpackage: `queries()` by name, `oracle_sql()` where SQL can express one.

Every query reads its whole table; paths are only opened by Spark's readers.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_extract, langid, lsh_forest, mixing, pii, quality_rules, secret_scan, simhash, url_filter
from .common import prepare

#: Where the public tokenizer files are; another folder can be named in the environment.
TOKENIZERS = "TOKENIZER_FOLDER"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a vocabulary file on this machine (it is installed on every node)."""
    if folder := os.environ.get(TOKENIZERS):
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_html_extract(spark, sf_dir):
    return html_extract.report(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op10_lsh_forest(spark, sf_dir):
    return lsh_forest.report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_pii, op3_simhash, op4_bpe, op5_mixing, op6_url_filter, op7_langid, op8_html_extract, op9_secret_scan, op10_lsh_forest)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality_rules.oracle_sql(), "op10_lsh_forest": lsh_forest.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op6_url_filter": url_filter.ORACLE_SQL}
