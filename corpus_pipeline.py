"""Corpus pipeline: documents to packed training sequences, in stages that each call one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import stored, table
from tidemark.llm.exact_dedup import keep_one_of_equal
from tidemark.llm.langid import drop_unknown
from tidemark.llm.near import keep_one_of_near
from tidemark.llm.packing import best_fit_packing
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; the model learns from all of `documents`.

    Null and empty texts have the model's base rate and stay as long as that is below the threshold. Equal texts score
    alike, so repeated rows stay or go together; null ids stay or go by their text. An empty table gives an empty one.
    """
    return drop_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go; the filters learn from all of `documents`.

    Null texts and texts without letters are in no language. Repeated rows stay or go together, null ids by their
    text; a tie of languages goes to the first by name and decides nothing here. An empty table gives an empty one.
    """
    return drop_unknown(docs, table(spark, sf_dir, "documents"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays.

    Null texts count as empty. A row with a null id stays only where no equal text has an id; of rows that repeat
    id and text any one stays. An empty table gives an empty one.
    """
    return keep_one_of_equal(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, that with the smallest id stays.

    SimHash sketches in a Gray-order index find the pairs, an exact comparison decides. Texts without words, null ones
    included, are linked. Null ids never name a group; a group of null ids alone stays. Rows that repeat the
    naming id all stay. An empty table gives an empty one.
    """
    return keep_one_of_near(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its sequence (shard, bin) and place there.

    Null and empty texts are one token long. Null sources conflict with nothing; repeated rows are packed each; of equal
    lengths the smaller id is placed first. An empty table gives an empty one.
    """
    return best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("language_id", language), ("exact_dedup", exact_dedup), ("simhash_near_dedup", near_dedup), ("best_fit_packing", packing)]
#: Classifiers, fingerprints and best fit aren't expressible in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
