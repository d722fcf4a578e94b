"""The corpus pipeline: stages over the documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import exact_dedup, langid, mixing, pieces, simhash
from rasterlake.session import remove, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; documents that are rejected go."""
    return langid.keep_identified(docs, langid.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sorted by training position."""
    return mixing.mix_documents(docs)


def place_in_files(docs: DataFrame) -> Column:
    """Rising with the order in which the rows were written: number of the task, its file, the row there; null for rows that are in no file.

    Spark writes a sorted table in the order of its tasks but reads the files by size, so the order of the rows themselves is lost.
    """
    try:
        file = docs.metadataColumn("_metadata")
        docs.select(file)
    except AnalysisException:
        return F.lit(None).cast("long")

    def number(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(file["file_name"], pattern, 1).try_cast("long"), F.lit(0).cast("long"))

    return (number("^part-([0-9]+)") * 1024 + number("-c([0-9]+)")) * 2**32 + file["row_index"]


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, lang and source, ``position`` (rising in training order), and the text as piece ids, which decode to it."""
    rows = docs.select("doc_id", "lang", "source", place_in_files(docs).alias("position"), "text")
    return pieces.encode(rows, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_texts),
]

# The stages learn a model and compare fingerprints, which SQL doesn't express; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; sort them by ``position`` for training order. What a stage wrote goes when the next has written its own,
    so only the table that the result is read from is left."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{number}")
        if number > 1:
            remove(spark, f"{folder}/{number - 1}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
