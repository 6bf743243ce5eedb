"""Continuous forms of the batch rules: first write wins, latest quote by ticker, daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.sources.workspace import exists, folders, remove


def first_seen(news: DataFrame, key: str = "uuid", time: str = "published_at", late: str = "36 hours") -> DataFrame:
    """One row for each key; state is dropped once the watermark has passed."""
    return news.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_bars(quotes: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Open, high, low, close and volume by ticker and day, emitted when the day is over."""
    bars = quotes.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), "ticker")
    at = F.col(time)
    bars = bars.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("ticker", F.col("w.start").cast("date").alias("date"), "open", "high", "low", "close", "volume")


def latest_quotes(quotes: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("ticker",)):
    """A query that keeps the newest quote of each key by ts in a Parquet folder; of quotes of one time the greatest.

    Each batch writes a version of its own from the last one before it, so a batch that runs twice writes the same, and a
    late quote changes nothing. The version before the last stays for readers that are at it; older ones are removed.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < epoch]
        rest = [c for c in batch.columns if c not in keys and c != "ts"]
        both = batch if not before else spark.read.parquet(_version(path, before[-1])).select(batch.columns).unionByName(batch)
        newest = both.groupBy(*keys).agg(F.max(F.struct("ts", *rest)).alias("_r")).select(*keys, "_r.*")
        newest.select(batch.columns).write.mode("overwrite").parquet(_version(path, epoch))
        for old in before[:-1]:
            remove(spark, _version(path, old))

    return quotes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _version(path: str, epoch: int) -> str:
    return f"{path}/version={epoch:012d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that were written whole, in order."""
    done = [folder for folder in folders(spark, path) if "version=" in folder and exists(spark, f"{folder}/_SUCCESS")]
    return sorted(int(folder.rsplit("version=", 1)[1]) for folder in done)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version, or None before the first."""
    known = versions(spark, path)
    return spark.read.parquet(_version(path, known[-1])) if known else None
