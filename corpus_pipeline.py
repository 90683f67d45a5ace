"""From raw documents to token digests in five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and reads it again for the next. Stages that filter keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardtable.llm import bpe, mixing, secrets, simhash, toxicity
from wardtable.llm.common import saved, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labels of these documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.drop_toxic(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints within four bits link stays, the one with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs, simhash.EXACT_64, words=4)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_digests(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "source"])


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Trained and hashed stages have no SQL twin; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
