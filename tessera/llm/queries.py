"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import collocations, cover_tree, decontaminate, html_text, lm, minhash, mixing, quality, ranked, rules, substrings, toxicity, url_filter
from tessera.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), listed)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes_of(table(spark, sf_dir, "documents"), size=2, percent=80)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_sentences", "n_removed")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_copies(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_mixing, op4_url_filter, op5_html_text, op6_minhash, op7_decontaminate, op8_substrings, op9_rules, op10_lm, op11_ranked, op12_cover_tree, op13_collocations)}

ORACLES = {"op4_url_filter": url_filter.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op10_lm": lm.ORACLE, "op11_ranked": ranked.ORACLE, "op12_cover_tree": cover_tree.ORACLE, "op13_collocations": collocations.ORACLE}
