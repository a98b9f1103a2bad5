"""The corpus pipeline: five stages over documents, each of which reads what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Stages handle
what their operators define: null and empty texts, repeated rows, empty tables; see quillstone/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontaminate, exact_dedup, mixing, quality, simhash
from quillstone.storage import discard, materialize, read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are good rather than poor or toxic, by the model fitted on the labels of these documents."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), quality.label_grade())
    return quality.select(docs, model, grade=2, least=0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest identifier of equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: a Jaccard similarity of 0.8 or more over five-word shingles."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all of a shorter one."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes half of the tokens by domain, language and source; adds tokens and how many epochs a document is in."""
    return mixing.mix(docs, mixing.corpus_levels(), mixing.WEIGHTS, seed=7)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
]

#: A fitted model and SimHash can't be written in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
