"""A cleaning pipeline over the documents: quality, near duplicates, benchmark leaks, mix of sources, shards.

Each stage works on all rows that the stage before kept and returns the columns of the documents; the last adds the
shard and the place in it. Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further
columns with clashing names have the results that the docstrings of the operators state; the stages add what follows. ``run`` writes every stage's rows to the shared folder and reads them as the next one's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datagauge.llm.decontaminate import decontaminated
from datagauge.llm.jaccard import one_of_each
from datagauge.llm.mixing import mixed
from datagauge.llm.quality import score_quality
from datagauge.llm.shared import stored
from datagauge.llm.sharding import histogram_shards

QUALITY = 0.5  # documents of a lower score go
# Where the stages learn and search in whole tables, SQL has no equivalent; tests compare each with a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject: null and empty texts are scored like others,
    rows that repeat an id or a text are judged alike, and no labels or no documents leave none out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, labels)
    return scored.where(F.col(scored.columns[-1]) >= QUALITY).drop(scored.columns[-1])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, whatever the ids; null and blank texts are no copies and stay."""
    return one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and blank texts hold none."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is one, and copies count as documents of their own."""
    return mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot; a null text has the size of its id."""
    return histogram_shards(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("mix_to_weights", mix_sources),
    ("histogram_sort", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
