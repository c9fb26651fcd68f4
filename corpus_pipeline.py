"""A training-data pipeline over ``documents``: filter, filter, deduplicate, pseudonymise, pack."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import dedup, packing, pii, quality, toxicity
from pixelloom.llm.common import stored, table
from pixelloom.llm.queries import PII_KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
THRESHOLD = 0.7


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; a null text is scored as an empty one and stays null."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, output="toxic_score").where(F.col("toxic_score") < THRESHOLD).select(COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; a null text is scored as an empty one and stays null."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, output="quality_score").where(F.col("quality_score") >= THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id.

    Repeated rows of it stay once, different texts under its id all stay; null texts count as empty; documents without an id all stay.
    """
    classes = dedup.near_duplicates(docs)
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi").select(COLUMNS).dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id IS NULL").select(COLUMNS))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data and ``n_chars`` counted again."""
    made = pii.pseudonymise(docs.select(COLUMNS), PII_KEY)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in sequences of 4096 tokens; a null text is one end token."""
    # Workers come from the stages before and an executor's heap has grown by then, so words and batches are fewer than packing's own.
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep_words=150_000, batch_bytes=2 << 20)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("pii", pseudonymise),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
