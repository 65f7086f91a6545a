"""The corpus pipeline: language ID, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet into the
shared folder and reads them back for the next, and removes a stage's rows once the next has its own.  All stages but the
last return the columns of ``documents``.

Defined cases, besides those of the operators: rows with a null or empty text, or one without a letter, go in the first
stage; rows with a null id all stay where their texts do; repeated rows become one in the third stage; extra columns are
carried up to the last stage, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from odflux.llm import langid, ngram_join, packing, quality_rules
from odflux.llm._common import durable, remove, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, or told too weakly, go."""
    return langid.keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated model."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each remaining document."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("packing", pack)]

#: The stages hold trained models, which SQL can't express; the tests hold each stage against its operator's own decisions,
#: and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
        if last:
            remove(spark, last)
        last = path
    packed = durable(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, last)
    return packed
