"""A bounded sample of labelled documents for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, fold, written

#: The fold whose labels are never used.
HELD_OUT = 2
#: Labelled rows that a classifier is fitted on, about, at most.
MAX_ROWS = 20_000


def training_rows(documents: DataFrame, labels: DataFrame, label: str, most: int = MAX_ROWS) -> DataFrame:
    """doc_id, text, label, fold of about `most` labelled documents, chosen by hash, none from the held-out fold.

    Null doc_ids and null labels are left out. Of several labels for one doc_id the largest counts.
    The sample is bounded, so it is broadcast to the documents; their texts are read once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
    n = known.count()
    part = min(1.0, most / max(1, n))
    if part < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1_000_000)) < int(part * 1_000_000))
    return written(documents_of(documents).join(F.broadcast(known), "doc_id"), "labelled", even=False)
