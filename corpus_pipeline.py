"""A corpus pipeline of five stages, each calling one training-data operator.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet
and read again as the next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import free_name, materialize, table
from docengine.llm.decontaminate import drop_contaminated
from docengine.llm.minhash_dedup import drop_near_duplicates
from docengine.llm.quality_knn import fit, score_quality
from docengine.llm.sharding import assign_shards
from docengine.llm.source_mix import emit_copies, mix_sources

#: Score from which a document is kept.
QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Empty texts get the labels' mean score."""
    name = free_name(docs, "_score")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels"), "quality"), name=name)
    return scored.filter(F.col(name) >= QUALITY).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, shingle=5, similarity=(80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as its source's target asks; one whose copies come to none is left out."""
    return emit_copies(mix_sources(docs), docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets its shard (``shard``) and the one it would have with one shard more (``grown_shard``)."""
    return assign_shards(docs, shards=8)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier and the LSH have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
