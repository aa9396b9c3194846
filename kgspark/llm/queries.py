"""Queries of the corpus operators over the given tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import ann, divergence, exact_dedup, jaccard_join, lexical, licenses, line_dedup, mixing, packing, quality_rules, suffix_dedup, toxicity, url_filter
from kgspark.llm._common import load, work_dir
from kgspark.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

#: The rules of the query: fixed values.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(load(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(load(spark, sf_dir, "embeddings"), k=20, query="id % 20 = 0")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digest(line_dedup.drop_frequent_lines(docs))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(load(spark, sf_dir, "pages"), URL_RULES)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(load(spark, sf_dir, "documents"), words=4, percent=85)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels.where(~held_out())))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path())


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the first batch of a new index."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{work_dir(spark)}/digest-index-{uuid.uuid4().hex}"
    with exact_dedup.DigestIndex(spark, path, exact_dedup.buckets_for(docs.count())) as index:
        return index.judge(docs, "documents")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_quality_rules, op3_nearest_neighbours, op4_line_dedup, op5_mixing, op6_license_scan, op7_url_filter, op8_jaccard_join, op9_toxicity, op10_packing, op11_exact_dedup, op12_source_divergence, op13_lexical_search)
}
