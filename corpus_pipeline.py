"""The curation pipeline over ``documents``: every stage's rows are written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm.common import table, written
from stridelake.llm.line_dedup import dedup_lines
from stridelake.llm.mixing import take_mix
from stridelake.llm.quality import keep_good
from stridelake.llm.sentencepieces import encode_digests, model_path
from stridelake.llm.simhash import near_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, takes for good.

    Null and empty texts are scored by the statistics of no words, very long ones whole; equal rows have equal scores; without labels all stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them; ``n_chars`` follows the text.

    Every row stays, perhaps with an empty text; null becomes empty. Of equal ids none is first: rows that repeat an id are one document.
    """
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies: SimHash of five words, within the bits that a Jaccard similarity of 0.8 makes.

    Texts without words are copies of each other; a null id comes after all others; rows that repeat the id that stays all stay.
    """
    return near_dedup(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and empty texts have no words and aren't taken; null is a source; repeated rows are dealt their copies apart, the same at every run.
    """
    return take_mix(docs).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests. A null text is empty, long ones are encoded whole, each row of a repeated id gives a row."""
    return encode_digests(docs, model_path()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("pieces", pieces)]
#: A fitted classifier, a random mix and a tokenizer are not expressible in SQL; tests/llm runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


pipeline = run
