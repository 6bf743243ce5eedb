"""What the training-data operators share: reading tables, cutting lineage, hashing, choosing frequent rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.sources.workspace import discard, new_folder, written  # noqa: F401  for the operators

#: ASCII white space, as the contracts define words: space, tab, LF, VT, FF, CR.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as string (null: empty), and further columns; all other columns are left out."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers, one to one, with all their bits mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4. A null doc_id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)), F.lit(0)).cast("int")


def frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows with the largest n, at most `most` of them: all above a cut that a histogram of n gives.

    Of the rows of about the same n that cross `most`, some are taken by hash; no task gathers more than a histogram.
    """
    step, part = F.floor(F.log2("n") * 16).cast("int"), F.pmod(F.xxhash64(*counted.columns), F.lit(1024)).cast("int")
    sizes = {r.step: r.rows for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()}
    taken = 0
    for k in sorted(sizes, reverse=True):
        if taken + sizes[k] > most:
            parts = {r.part: r.rows for r in counted.where(step == k).groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()}
            end = 0
            while taken + parts.get(end, 0) <= most:
                taken += parts.get(end, 0)
                end += 1
            return counted.where((step > k) | ((step == k) & (part < end)))
        taken += sizes[k]
    return counted


def fan_out(owners: int, fan: int) -> tuple[int, int]:
    """Owners, at least so many, and hops to reach them, each of them dividing a range evenly among at most fan ones."""
    hops = 1
    while fan**hops < owners:
        hops += 1
    each = next(k for k in range(1, fan + 1) if k**hops >= owners)
    return each**hops, hops
