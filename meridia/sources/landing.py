"""The landing zone: files of JSON lines {endpoint, ticker, payload} that are taken in once each, in batches or as a stream.

Spark's file source keeps which files it has read in its checkpoint. A run takes all files that are there and ends; the next one takes what
came since. Every batch is merged into stored tables by key, the later file's payload first, so a batch that is repeated after a
lost run changes nothing. Lines that are no such objects, or whose payload lacks its key fields, go to a table of their own with file and text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators.upsert import insert_ignore, upsert

from .ingest import SPECS, has_keys, last_of_each, typed
from .stored import Merge, StoredTable, by_bucket
from .workspace import discard, written

_MALFORMED = ["file", "line", "reason"]


@dataclass(frozen=True)
class Target:
    """Where an endpoint's rows go: the declaration that types them, the table, and how it takes them (an upsert by the declaration's keys)."""

    spec: str
    table: StoredTable
    how: Merge | None = None


class Landing:
    def __init__(self, spark: SparkSession, zone: str, state: str, targets: dict[str, Target]):
        self.spark, self.zone, self.state, self.targets = spark, zone, state, targets
        self.malformed = StoredTable(spark, f"{state}/malformed", by_bucket(["file"], 4))

    def take(self, files_a_batch: int | None = None, follow: bool = False):
        """Takes in what has come since the last run and ends; or, with follow, goes on as a stream and gives its query."""
        reader = self.spark.readStream.option("recursiveFileLookup", "true")
        reader = reader.option("maxFilesPerTrigger", str(files_a_batch)) if files_a_batch else reader
        lines = reader.text(self.zone).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("came"))
        writer = lines.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.state}/checkpoint")
        if follow:
            return writer.start()
        return writer.trigger(availableNow=True).start().awaitTermination()

    def _batch(self, lines: DataFrame, _: int) -> None:
        envelope = F.from_json("value", "endpoint string, ticker string, payload string").alias("_e")
        rows = written(lines.select("file", "came", F.col("value").alias("line"), envelope).select("file", "came", "line", "_e.*"), "landed")
        known = F.col("endpoint").isin(*self.targets) & F.col("payload").isNotNull()
        bad = rows.where(~F.coalesce(known, F.lit(False))).withColumn("reason", F.lit("no endpoint and payload"))
        for endpoint, target in self.targets.items():
            spec = SPECS[target.spec]
            own = rows.where((F.col("endpoint") == endpoint) & F.col("payload").isNotNull())
            made = typed(own, spec, "payload", F.struct("came", "file"), F.struct(*rows.columns).alias("_from"))
            keys = list(spec.keys)
            target.table.merge(last_of_each(made.drop("_from"), spec), target.how or (lambda old, new, keys=keys: upsert(old, new, keys)))
            bad = bad.unionByName(made.where(~has_keys(spec)).select("_from.*", F.lit("no key fields").alias("reason")))
        self.malformed.merge(bad.select(*_MALFORMED), lambda old, new: insert_ignore(old, new, _MALFORMED))
        discard(rows)

