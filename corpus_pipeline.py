"""Corpus preparation in five stages, each run on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlake.llm import common, mixing, near_dedup, piece_codec, quality_fm, quality_rules

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: failing lines go from the texts, and rejected documents go."""
    common.ship(spark)
    kept = quality_rules.clean(docs.select(*DOCUMENTS), in_place=True).where("kept")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def score_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted on the labelled documents that are left; those predicted 0 go."""
    common.ship(spark)
    model = quality_fm.train(docs, common.table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, model).where("predicted = 1").select(*DOCUMENTS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: one document of each group stays."""
    common.ship(spark)
    return near_dedup.drop_near_duplicates(docs).select(*DOCUMENTS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a document is repeated or left out as its source's target asks, in training order."""
    common.ship(spark)
    sized = docs.withColumn("mix_size", common.space_words())
    return mixing.in_training_order(mixing.mix(sized, docs.count(), tie=("text",))).select(*DOCUMENTS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document; ``lossless`` tells whether they decode to its text."""
    common.ship(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_codec.encode(docs, path, check=True)
    return encoded.select("doc_id", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "lossless")


STAGES = [
    ("quality rules", clean_lines),
    ("quality classifier", score_quality),
    ("near duplicates", drop_copies),
    ("mixing", mix_sources),
    ("piece encoding", encode_pieces),
]

#: Fitted models, hashes and seeded draws are beyond SQL; tests/llm checks every stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage{k}")
    return docs
