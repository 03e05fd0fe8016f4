"""From raw documents to the order they are trained on: five stages, each one operator of tessella.llm.

Every stage takes and returns whole documents (the last adds what the mix takes of them) and works on
all that the stage before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontam, mixing, pii, quality, simhash
from tessella.llm.common import checkpoint_dir, drop_stored, read


def reject_unfit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_fit(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: SimHash candidates, held to an exact likeness."""
    return simhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced and n_chars brought in line."""
    return pii.redact(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, a row for each copy of a document, in training order."""
    return mixing.training_order(docs)


STAGES = [
    ("quality classifier", reject_unfit),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
]

#: Trained models and hashes that DuckDB lacks stand between documents and result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is written to the shared folder for the next, and goes
    once the next one's is written. The last of these tables stays, as the result reads it."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            drop_stored(spark, before)
        before = out
    return STAGES[-1][1](spark, docs, sf_dir)
