"""The corpus pipeline: quality rules, exact dedup, near-duplicate removal,
mixing to target weights, and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents, whatever other columns a table has and whatever their names.
An empty table stays empty.  Rows with a null key are documents like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoledger.llm import bpe, exact_dedup, jaccard_join, mixing, quality_rules
from chronoledger.llm.common import Stage
from chronoledger.llm.queries import MIX_BLOCK_BYTES, MIX_OTHER, MIX_WEIGHTS


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.  A null or empty text has too few
    words; repeated rows and equal texts are judged alike."""
    return quality_rules.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A to Z lower-cased; null as empty), the document with the
    largest id; a null id is the smallest.  Of rows that repeat one id and text
    one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, Jaccard 0.8 or more, linked
    directly or by others), the document with the smallest id.  Texts without
    words are near nothing; rows with a null id stay."""
    return jaccard_join.drop_near_duplicates(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture of their sources.  Null and
    unnamed sources are one source; a null text takes one byte.  Ties within a
    source are broken by id, size and a checksum of the text; rows that repeat an
    id take its earliest place."""
    return mixing.in_mixed_order(docs, MIX_WEIGHTS, MIX_BLOCK_BYTES, MIX_OTHER)


def tokenized_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, the SHA-256 of the bytes they decode to
    (its text's, if the round trip is right), and its place in the mixture: reading by
    (slot, start_byte) gives the mixture, in whatever files the rows are.  A null
    text has no tokens; repeated rows have a row each."""
    import public_tokenizers as vocab

    path = vocab.path("byte_bpe_50k.tiktoken")
    placed = mixing.places(docs, MIX_WEIGHTS, MIX_BLOCK_BYTES, MIX_OTHER).withColumnRenamed("doc_id", "_placed")
    # Texts join their places before they are tokens, which are longer.
    texts = docs.select("doc_id", "source", "text").join(placed, F.col("doc_id").eqNullSafe(F.col("_placed"))).select("doc_id", "source", "slot", "start_byte", "text")
    ids = bpe.decode_tokens(bpe.encode_texts(texts, path, vocab.PATTERN, offsets=False).drop("text"), path, vocab.PATTERN)
    return ids.select("doc_id", "source", "slot", "start_byte", "token_ids", F.sha2("decoded_bytes", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_documents),
    ("exact_dedup", distinct_documents),
    ("jaccard_join", dissimilar_documents),
    ("pfair_mixing", mixed_documents),
    ("byte_bpe", tokenized_documents),
]

#: Tokens are not to be had in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = Stage(spark, "pipeline")
    for n, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stage.write(docs)
    return docs
