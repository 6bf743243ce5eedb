"""Documents to packed training sequences: filter, deduplicate twice, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again for the next. All but the last return the columns of documents, extra ones with them.

Null texts count as empty: the classifier scores them, exact dedup keeps one of them and of the empty ones, near dedup links them
with nothing, and the mix, which deals in words, never serves them. Of rows that repeat a doc_id and text one stays
after exact dedup; rows with equal or null doc_ids and other texts are documents of their own. Without any labels all
documents pass the classifier. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.llm.common import table, written
from meridia.llm.exact_dedup import first_copies
from meridia.llm.mixing import mixed_documents
from meridia.llm.near_dedup import one_of_each
from meridia.llm.packing import pack
from meridia.llm.quality import accepted_documents
from meridia.llm.queries import tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7."""
    return accepted_documents(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each set of equal texts."""
    return first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by five-word shingles at 0.8."""
    return one_of_each(docs, width=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix serves them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences."""
    return pack(docs, tokenizer("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier, MinHash and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), even=False)
    return STAGES[-1][1](spark, docs, sf_dir)
