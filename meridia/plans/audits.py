"""A run of ingest steps into stored tables, logged in two phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.upsert import insert_ignore, upsert
from meridia.sources.audit import IngestAudit, Step
from meridia.sources.domain import Tables
from meridia.sources.ingest import fan_out
from meridia.sources.landing import Landing, Target
from meridia.sources.stored import StoredTable, by_bucket, by_month
from meridia.sources.workspace import new_folder

from .payloads import fundamentals_payloads


def _broken(t: Tables) -> DataFrame:
    return t.dividends.withColumn("value", F.raise_error(F.lit("the source does not answer")).cast("double"))


def ingest_runs(t: Tables) -> DataFrame:
    """endpoint, status, rows_written, failed of a run whose third step fails: prices, the tables that payloads fan out to, and dividends."""
    folder = new_folder(t.spark, "ingest-run")
    found = fan_out(fundamentals_payloads(t))
    stored = lambda name, slices: StoredTable(t.spark, f"{folder}/{name}", slices)
    prices, holders, earnings = stored("eod_prices", by_month("date")), stored("holders", by_bucket(["ticker"], 8)), stored("earnings", by_bucket(["ticker"], 8))
    key = ["ticker", "date"]
    steps = {
        "eod_prices": Step(lambda: t.eod_prices, lambda rows: prices.merge(rows, lambda old, new: upsert(old, new, key))),
        "institutional_holders": Step(
            lambda: found["institutional_holders"], lambda rows: holders.merge(rows, lambda old, new: upsert(old, new, ["ticker", "holder_name", "report_date"]))
        ),
        "dividends": Step(lambda: _broken(t), lambda rows: stored("dividends", by_bucket(["ticker"], 8)).append(rows)),
        "earnings_history": Step(lambda: found["earnings_history"], lambda rows: earnings.merge(rows, lambda old, new: insert_ignore(old, new, ["ticker", "report_date"]))),
        "sentiment": Step(lambda: t.sentiment_daily),
    }
    audit = IngestAudit(t.spark, f"{folder}/log")
    audit.run_all(steps)
    runs = audit.runs().where("started_at <= finished_at")
    return runs.select("endpoint", "status", "rows_written", F.col("error_message").isNotNull().alias("failed"))


def _landed(t: Tables) -> Landing:
    """A zone that prices come to in two goes: the odd days, then the even ones with the first days of months again; and lines that are nothing."""
    folder = new_folder(t.spark, "landing")
    table = StoredTable(t.spark, f"{folder}/eod_prices", by_month("date"))
    landing = Landing(t.spark, f"{folder}/zone", f"{folder}/state", {"eod": Target("eod_prices", table)})
    fields = [F.col("date").cast("string").alias("date"), "high", "low", "close", "adjusted_close", "volume"]
    line = lambda close: F.to_json(F.struct(F.lit("eod").alias("endpoint"), "ticker", F.to_json(F.struct(*fields[:3], close.alias("close"), *fields[4:])).alias("payload")))
    odd = F.day("date") % 2 == 1
    first = t.eod_prices.where(odd).select(line(F.col("close") + F.when(F.day("date") == 1, 1).otherwise(0)).alias("value"))
    nothing = t.read("region").select(F.explode(F.array(F.concat(F.lit("no json "), "r_name"), F.concat(F.lit('{"endpoint":"eod","payload":"{}","ticker":"'), "r_name", F.lit('"}')))))
    first.unionByName(nothing.toDF("value")).write.text(f"{folder}/zone/first")
    landing.take()
    t.eod_prices.where(~odd | (F.day("date") == 1)).select(line(F.col("close")).alias("value")).write.text(f"{folder}/zone/second")
    landing.take()
    return landing


def landed_prices(t: Tables) -> DataFrame:
    return _landed(t).targets["eod"].table.read().drop("open")


def landed_malformed(t: Tables) -> DataFrame:
    """reason and how many lines."""
    return _landed(t).malformed.read().groupBy("reason").agg(F.count("*").alias("n"))


PLANS = {"ingest_runs": ingest_runs, "landed_prices": landed_prices, "landed_malformed": landed_malformed}
SQL = {
    "landed_prices": "SELECT ticker, date, high, low, close, adjusted_close, volume FROM eod_prices",
    "landed_malformed": "SELECT unnest(['no endpoint and payload', 'no key fields']) AS reason, count(*) AS n FROM region",
    "ingest_runs": " UNION ALL ".join(
        [f"SELECT '{n}' AS endpoint, 'ok' AS status, (SELECT count(*) FROM {s}) AS rows_written, false AS failed" for n, s in
         (("eod_prices", "eod_prices"), ("institutional_holders", "institutional_holders"), ("earnings_history", "earnings_history"), ("sentiment", "sentiment_daily"))]
        + ["SELECT 'dividends', 'failed', NULL, true"]
    ),
}
