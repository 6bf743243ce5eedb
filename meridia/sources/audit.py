"""The ingest log in two phases: a row when a step starts and one when it ends, under one run id; row counts come with the write itself."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ROW = "run_id string, endpoint string, phase string, status string, rows_written long, error_message string"


@dataclass(frozen=True)
class Step:
    """make gives the rows of an endpoint, save writes them; a step without save is only counted."""

    make: Callable[[], DataFrame]
    save: Callable[[DataFrame], object] | None = None


class IngestAudit:
    """Rows are only ever appended, so writers do not disturb each other and a run that died shows as running."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, *row) -> None:
        rows = self.spark.createDataFrame([row], _ROW).withColumn("at", F.current_timestamp())
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def start(self, endpoint: str) -> str:
        run_id = uuid.uuid4().hex
        self._append(run_id, endpoint, "start", "running", None, None)
        return run_id

    def end(self, run_id: str, endpoint: str, status: str, rows: int | None = None, error: str | None = None) -> None:
        self._append(run_id, endpoint, "end", status, rows, error)

    def runs(self) -> DataFrame:
        """A row a run: endpoint, started_at, finished_at (null while it runs, or if it died), status, rows_written, error_message."""
        rows = self.spark.read.parquet(self.path)
        ended = F.col("phase") == "end"
        last = F.max_by(F.struct("status", "rows_written", "error_message"), F.struct(ended, "at"))
        by_run = rows.groupBy("run_id", "endpoint").agg(
            F.min(F.when(~ended, F.col("at"))).alias("started_at"), F.max(F.when(ended, F.col("at"))).alias("finished_at"), last.alias("_last")
        )
        return by_run.select("run_id", "endpoint", "started_at", "finished_at", "_last.*")

    def run(self, endpoint: str, step: Step) -> int:
        """Runs a step between its two rows and gives the rows it wrote. They are observed in the pass that writes them. A failure is logged and raised."""
        run_id = self.start(endpoint)
        try:
            seen = Observation()
            rows = step.make().observe(seen, F.count(F.lit(1)).alias("rows"))
            if step.save:
                step.save(rows)
            else:
                rows.write.format("noop").mode("overwrite").save()
            n = seen.get["rows"]
        except Exception as e:
            self.end(run_id, endpoint, "failed", error=f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
            raise
        self.end(run_id, endpoint, "ok", n)
        return n

    def run_all(self, steps: dict[str, Step]) -> dict[str, int | None]:
        """Every step in turn, those after one that fails too; rows written by endpoint, None where it failed."""
        done: dict[str, int | None] = {}
        for endpoint, step in steps.items():
            try:
                done[endpoint] = self.run(endpoint, step)
            except Exception:  # noqa: BLE001  the log tells which and why
                done[endpoint] = None
        return done
