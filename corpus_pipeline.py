"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import decontam, exact_dedup, language, mixing, simhash
from tracelode.llm.common import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognisable language; those rejected go.

    A row goes if its text is null, has no letter, or if no labelled row exists
    to learn from.  Every row is judged by its own text, so null and repeated
    ids change nothing and repeated rows share their fate; long texts are read
    whole; extra columns are kept; an empty table stays empty.
    """
    return language.language_filter(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space.

    The longest stays, then that of the least id (null last); null and blank
    texts are one group; of repeated rows one stays; extra columns are kept; an
    empty table stays empty.
    """
    return exact_dedup.exact_dedup_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component.

    That of the least id stays, null ids last, and of rows that share it the one
    of the least digest.  Null and wordless texts have one fingerprint, so one
    of them stays; extra columns are kept; an empty table stays empty.
    """
    return simhash.near_dedup_filter(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    A row goes if a full window of 13 benchmark words occurs in it, or if
    shorter items make up a twentieth of it.  Null and wordless texts stay; rows
    are judged one by one, whatever their ids; extra columns are kept; an empty
    table or benchmark drops nothing.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered source, language and topic weights.

    Rows are drawn by id and text, so null and repeated ids are drawn one by one
    and repeated rows together; null labels are a value of their own; wordless
    texts are drawn at the overall rate; extra columns are kept; an empty table
    stays empty.
    """
    return mixing.mix_filter(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", sample_mixture),
]

#: Language identification and near-dedup cannot be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
