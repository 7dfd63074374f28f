"""From raw documents to packed training sequences: five operators, each on all that the one before kept.

Null and empty texts and null ids pass every filter and are packed as an end alone. Repeated rows: the second stage keeps
one; the others treat each by itself. The first stage learns from the labels of all documents, those that it filters included. Very long texts are taken whole. An empty table gives no rows. Columns beyond id and
text are passed on until packing, whatever their names. Each stage's result is written and read back, which ends lineage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontamination, neardup, packing, secrets, toxicity
from tallyforge.llm.common import discard, materialise, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the recurrent network, trained on labelled ones, scores 0.5 or more."""
    return toxicity.keep_clean(docs, toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, for each group that five-word shingles link at 0.8; rows without words or id all stay."""
    return neardup.keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten words in a row of a benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs, TOKENIZER, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The recurrent network and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        if written is not None:  # what the stage read is not read again
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
