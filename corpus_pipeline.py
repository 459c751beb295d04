"""Training-data pipeline over `documents`: toxicity, exact and near duplicates, source mixing, BPE round trip.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from tracewarden.llm.common import table, written

#: Toxicity and near duplicates cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
#: Words of a shingle, as in op9.
WIDTH = 4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7; null texts are not toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model).filter(F.col("score") < toxicity.REJECT).select(COLUMNS)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the rows with the largest doc_id."""
    return exact_dedup.exact_dedup(docs.select(COLUMNS)).filter("kept").select(COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id; rows with a null doc_id stay."""
    verdict = near_dedup.near_duplicates(docs.select("doc_id", "text"), width=WIDTH)
    gone = verdict.filter("NOT kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows each."""
    taken = mixing.mix(docs.select(COLUMNS)).filter("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.expr("sequence(1, cast(copies AS int))"))).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents with the number and digest of their token ids, and the digest of what these decode to."""
    out = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path(bpe.VOCABULARY))
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
