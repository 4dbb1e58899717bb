"""Corpus pipeline: raw documents to token ids, in five written stages.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that
the stage before it kept. Language ID lets go what has no clear language; the
Jaccard join keeps the first document of each near-duplicate class; personal
data is replaced in the texts; mixing draws documents so that token weights
meet the raked marginals; BPE encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import bpe, jaccard, langid, mixing, pii
from kpiloom.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the hash of the text that they decode to."""
    import public_tokenizers

    out = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data),
          ("mixing", mixture), ("BPE", encode)]

#: Min-hash buckets, trained weights and merges have no SQL form. The stages' operators have tests of their own; no test runs the pipeline as a whole yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
