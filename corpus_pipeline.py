"""A training-data pipeline over ``documents``: each stage's result is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kaivo.llm import langid, mixing, neardup, packing, passages
from kaivo.llm.scratch import together, written
from kaivo.session import reachable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labels of these documents themselves.

    Each row is judged by its own text: null and letterless texts go, whatever their ids; repeated rows share one verdict. Other
    columns stay as they are. Without a labelled text there is no model, and all rows go; an empty table gives none.
    """
    return langid.recognised(together(docs), langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the one of smallest doc_id (rows without one come last).

    Rows that share a doc_id are judged by their own texts; of equal rows one stays. Wordless texts all stay.
    """
    return neardup.one_of_each(together(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document of smaller doc_id has too.

    A document left without words goes; null, empty and short texts, and rows without a doc_id, stay to the byte.
    """
    return passages.without_repeats(together(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them; null is a source of its own, wordless texts come once.

    Repeated rows have one key, and a cut among them takes the same share of each.
    """
    return mixing.mixed(together(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null or empty text is its end id alone, and each repeated row is packed by itself."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packed", packed)]

#: Tokenising and language identification are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
