"""Cleaning pipeline over ``documents``: five stages, each written as Parquet and read again.

Every stage decides on all rows that its predecessor kept: documents that fail
the quality rules go; boilerplate lines go from the texts; one document of each
group of near copies stays; documents that hold a benchmark window go; what is
left is mixed to the sources' target weights. The last stage returns each
document it takes with its copies and the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import decontamination, jaccard_join, line_dedup, mixing, repetition
from hearsay.llm.shipping import ship
from hearsay.llm.tables import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this percentage of their word n-grams; op7_jaccard_join has its own values.
COPY_NGRAM, COPY_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_good(docs.select(*COLUMNS))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text."""
    kept = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs.select(*COLUMNS), n=COPY_NGRAM, percent=COPY_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs.select(*COLUMNS), items)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", source_mix),
]

#: The repetition shares of the first stage and the components of the third are not plain SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
