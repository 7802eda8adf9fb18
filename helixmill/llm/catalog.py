"""The queries of the training-data operators by name, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, htmltext, langid, linededup, pii, simhash, tokencount, topk, urlfilter
from .common import table


#: The key of the registered query's surrogates; other callers bring their own.
QUERY_KEY = b"op8 query"


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.result(table(spark, sf_dir, "documents"), QUERY_KEY)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.result(table(spark, sf_dir, "documents"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.digests(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.digests(table(spark, sf_dir, "pages"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.digests(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {"op1_token_counts": op1_token_counts, "op2_url_filter": op2_url_filter, "op3_html_text": op3_html_text, "op4_topk": op4_topk, "op5_simhash": op5_simhash, "op6_bpe": op6_bpe, "op7_decontamination": op7_decontamination, "op8_pii": op8_pii, "op9_line_dedup": op9_line_dedup, "op10_language": op10_language, "pipeline": pipeline}


def oracle_sql():
    return {"op4_topk": topk.SQL, "op7_decontamination": decontam.SQL, "op9_line_dedup": linededup.SQL}
