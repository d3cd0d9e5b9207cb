"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and
read again as the next stage's ``docs``. Every stage judges rows by their texts: null and empty texts are kept
(near-dedup takes all wordless texts for copies of each other), repeated ids stay rows of their own, and an empty
table gives an empty one. Rows with a null id are documents like others; in near-dedup they come last in a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, line_templates, mixing, simhash, toxicity
from marginalia.llm.common import saved, table
from marginalia.llm.queries import domain_labels

#: Target shares of tokens by domain. Toxic text has none: the first stage removes it, and what it missed isn't brought back.
TARGETS = {"good": 0.9, "poor": 0.1}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def remove_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays, with the length of what is left."""
    return line_templates.drop_recurring_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id."""
    return simhash.keep_first(docs, null_ids=True).select(*COLUMNS)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), "drop").select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the rate, and the whole number of copies, at which the mixture reads it."""
    labels = domain_labels(table(spark, sf_dir, "labels")).where("label <> 'toxic'")
    found = mixing.mix(docs, labels, TARGETS)
    return found.select("doc_id", "n_tokens", "domain", F.round("rate", 6).alias("rate"), "copies")


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_recurring_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_leaks),
    ("mixing", mix_to_targets),
]

#: Fitted models and fingerprints have no SQL form; the operators behind the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
