"""A corpus pipeline of four stages: language ID, near-dedup, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs. The first
three return the columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episodica.llm.common import durable, table
from episodica.llm.langid import keep_identified
from episodica.llm.minhash import keep_one
from episodica.llm.mixing import mix, shuffled
from episodica.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, or with no language above chance, go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarities of 0.8 or more of their five-word shingles."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson numbers so that a source of n rows weighs as the square root of n, in random order."""
    return shuffled(mix(docs)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences of at most 2048 ids."""
    return pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A trained network, Poisson draws and the packing plan are not SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
