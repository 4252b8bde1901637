"""A corpus from raw documents: language, exact copies, near copies, source mix, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last return
the columns of ``documents``. Between stages the rows are written as Parquet and read again, so a lost executor
costs the running stage only.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quaymark.llm import common, exact_dedup, jaccard_join, language, mixing, sentencepiece_codec
from quaymark.session import ship

TOKENIZER = "piece_bpe_32k.model"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; texts without a letter go."""
    return language.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of similarity 0.8 on five-word shingles, the smallest doc_id stays."""
    return jaccard_join.representatives(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, token_ids, decodes`` of every row."""
    return sentencepiece_codec.encoded(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language identification", known_language),
    ("exact deduplication", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("source mixing", mixed_sources),
    ("SentencePiece encoding", token_ids),
]

#: Trained and hashed stages have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir))
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
