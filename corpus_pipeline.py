"""Corpus pipeline: toxicity, quality, near duplicates, benchmark passages, packing.

Each stage reads what the one before has written. The classifiers are fitted on labelled documents
of their own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loudframe.llm import decontamination, near_dedup, packing, quality, toxicity
from loudframe.llm.common import TEXT_ROWS, arrow_rows, stored, table
from loudframe.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Labels are met by doc_id; without labels of both kinds the share of toxic ones decides for all.

    A null text counts as empty and stays; long texts are read whole; repeated rows are judged alike; an empty table stays empty; further columns stay.
    """
    with arrow_rows(spark, TEXT_ROWS):
        return stored(toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), "not-toxic")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as bad go, by rules fitted on the labels of what came in.

    Null and empty texts have statistics of zero; long texts are measured whole; repeated rows are judged alike; an empty table stays empty; further columns stay.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts stays, that with the smallest id of the group's first text.

    Null and empty texts are one text, null ids come last, of rows equal in id and text one stays; an empty table stays empty; further columns stay.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    Null and empty texts have no passage and stay; long texts are scanned whole; repeated rows are judged alike; an empty table or benchmark removes nothing; further columns stay.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; the columns of documents give way to those of pieces.

    A null or empty text is an end id alone; a long text is cut over several sequences; repeated rows are packed each; an empty table gives no pieces.
    """
    with arrow_rows(spark, TEXT_ROWS):
        return stored(packing.pack_documents(docs, tokenizer_path()), "pieces")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: Fitted models and tokenizers can't be said in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
