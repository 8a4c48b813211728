"""The corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the
next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, minhash, mixing, substrings, toxicity
from tessera.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject, with the columns they came with.

    The model is fitted on labels of these very documents. Null and empty texts get the bias alone and stay; rows that repeat are each
    judged; without labels, or with an empty table, nothing is rejected; other columns pass through whatever their names.
    """
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), the least doc_id, with the columns it came with.

    Texts without words and rows without an id link with nothing and stay; rows that repeat an id stand and fall together, so a row twice with
    one text stays twice; an empty table gives no rows.
    """
    return minhash.one_of_each(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier place in the corpus has too; only text changes.

    Null texts stay null and empty ones empty; a text that is all repeats becomes empty and stays; rows alike in id and text are one
    document and keep the same text; an id of null sorts first; an empty table gives no rows. n_chars is left as it came.
    """
    return substrings.clean_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates (a twentieth of their words or more), with the columns they came with.

    Null and empty texts have no words and stay; rows that repeat are each judged; without items nothing goes; an empty table gives no rows.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken.

    Null and empty texts have size 0 and are never taken; a null source is one of its own; rows that repeat hold places of their own; an empty
    table gives no rows.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Trained models, signatures and hashed draws are beyond SQL; tests hold every stage's output on its own input against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
