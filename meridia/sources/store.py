"""Result sinks, the ingest log and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import without_nan


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for results that are small by then."""
    without_nan(df).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, folder: str, name: str) -> str:
    """JSON lines under folder/name with ISO dates, and folder/latest, which names the newest."""
    path = f"{folder}/{name}"
    without_nan(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    df.sparkSession.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").json(f"{folder}/latest")
    return path


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(f"{folder}/{spark.read.json(f'{folder}/latest').first()['name']}")


def log_ingest(spark: SparkSession, path: str, endpoint: str, started: str, status: str, rows: int | None = None, error: str | None = None) -> None:
    """Appends a row; an ingest that runs twice leaves two."""
    row = spark.createDataFrame([(endpoint, started, status, rows, error)], "endpoint string, started string, status string, rows_written long, error_message string")
    row.select("endpoint", F.to_timestamp("started").alias("started_at"), F.current_timestamp().alias("finished_at"), "status", "rows_written", "error_message").coalesce(1).write.mode("append").parquet(path)


def validate_schema(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> list[str]:
    """'table.column' of each column that is missing, 'table' of each table."""
    missing = [t for t in required if t not in tables]
    return missing + [f"{t}.{c}" for t, columns in required.items() if t in tables for c in columns if c not in tables[t].columns]


def distinct_values(df: DataFrame, column: str, most: int = 50) -> list:
    """The values of an enumerated column, for a check by eye."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).limit(most).collect()]
