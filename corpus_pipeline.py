"""From documents to token ids: quality filter, exact dedup, near dedup, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the mix repeats a document that it takes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orestrata.llm import byte_bpe, exact_dedup, minhash, mixing, quality
from orestrata.llm.common import WIDE, table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labels outside its held-out fifth, scores under 0.3 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the longest, then the first stays."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id stays."""
    return minhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document appears once for each time it is taken."""
    return mixing.repeat_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents but text, and ids, n_tokens and whether the ids decode to the text's very bytes. Written here, as
    a caller's own write would hand whole texts to the workers 10,000 rows at once."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return written(byte_bpe.with_ids(docs, path, pattern), WIDE)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing to target weights", mixture),
    ("byte-level BPE", token_ids),
]

#: The classifier and the mix are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
