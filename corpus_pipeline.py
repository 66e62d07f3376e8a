"""The corpus pipeline: quality, near-dedup, personal data, mixing, packing.

Every stage is a function of (spark, docs, sf_dir); ``run`` writes each result as Parquet in the shared
folder and rereads it as the next stage's ``docs``. All but the last return the columns of documents.

Every stage takes null texts (empty to the classifier, the packer and the mixer; kept by near-dedup and left as
they are by the personal-data stage), null ids (kept apart by near-dedup), null languages and sources (a site and
a leaf of their own), empty and very long texts, repeated rows (near-dedup keeps one), empty tables (empty
results) and further columns of any name, which all but the last stage hand on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordf.llm.binpack import packed
from arbordf.llm.common import Workspace, n_words, scratch, table
from arbordf.llm.minhash import deduplicated
from arbordf.llm.mixing import mixed
from arbordf.llm.pii import redacted
from arbordf.llm.quality import good_documents
from arbordf.llm.queries import DOMAIN_SQL, WEIGHTS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    return deduplicated(docs, shingle=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to markers; n_chars follows."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A budget of 80 % of the tokens by target weights, each document in at most two epochs."""
    return mixed(docs, F.expr(DOMAIN_SQL), WEIGHTS, share=(8, 10), max_epochs=2, seed=1, own_only=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences of several permitted lengths, in words."""
    return packed(docs.withColumn("n_tokens", n_words()))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]
#: The classifier, the segmentation field and the packer are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; the last one's rows. What a stage leaves in the shared folder besides its
    result goes with it."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():
            before, docs = docs, ws.written(stage(spark, docs, sf_dir), name)
        ws.drop(before)
    return docs
