"""Write rules and payload ingestion over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.latest import as_of_join
from meridia.operators.upsert import coalescing_upsert, enrich, insert_ignore, upsert, upsert_partial
from meridia.sources.domain import Tables
from meridia.sources.ingest import SPECS, explode_dated, ingest

_KEY = ["ticker", "date"]


def _old(t: Tables) -> DataFrame:
    return t.eod_prices.where("date <= date '2001-03-31'").select("ticker", "date", "close", F.when(F.day("date") % 2 == 0, F.col("volume")).alias("volume"))


def _new(t: Tables) -> DataFrame:
    return t.eod_prices.where("date > date '2001-02-28'").select("ticker", "date", (F.col("close") + 1).alias("close"), F.when(F.day("date") % 3 == 0, F.col("volume") + 1).alias("volume"))


def ingest_eod(t: Tables) -> DataFrame:
    """Prices as payload text and back; a repeated day keeps the later payload."""
    p = t.eod_prices.select("ticker", F.to_json(F.struct(F.col("date").cast("string").alias("date"), "high", "low", "close", "adjusted_close", "volume")).alias("payload"), F.lit(1).alias("seen"))
    bad = t.eod_prices.where("day(date) = 1").select("ticker", F.to_json(F.struct(F.col("date").cast("string").alias("date"), F.lit("N/A").alias("close"))).alias("payload"), F.lit(0).alias("seen"))
    return ingest(p.unionByName(bad), SPECS["eod_prices"], order="seen").drop("open")


def ingest_statements(t: Tables) -> DataFrame:
    """Yearly statements from one nested payload a ticker."""
    row = F.to_json(F.struct(F.col("date").cast("string").alias("date"), F.coalesce(F.col("filing_date").cast("string"), F.lit("0000-00-00")).alias("filing_date"), F.col("total_revenue").alias("totalRevenue"), F.col("net_income").alias("netIncome")))
    entries = t.statements.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), row))).alias("m"))
    payload = entries.select("ticker", F.to_json(F.create_map(F.lit("yearly"), F.col("m"))).alias("payload"))
    opened = explode_dated(payload, "payload", "yearly", "quarterly").withColumnRenamed("section", "period_type")
    return ingest(opened, SPECS["statements"]).select("ticker", "date", "period_type", "filing_date", "total_revenue", "net_income")


def asof_price(t: Tables) -> DataFrame:
    """Each filing with the last close up to it; histories are dealt out by year."""
    probes = t.institutional_holders.select("ticker", "holder_name", "report_date")
    return as_of_join(probes, t.eod_prices, ["ticker"], "report_date", "date", {"price": "close"}, at="price_date", period=F.year("_time"))


PLANS = {
    "upsert": lambda t: upsert(_old(t), _new(t), _KEY),
    "upsert_partial": lambda t: upsert_partial(_old(t), _new(t), _KEY, ["volume"]),
    "coalescing_upsert": lambda t: coalescing_upsert(_old(t), _new(t), _KEY),
    "insert_ignore": lambda t: insert_ignore(_old(t), _new(t), _KEY),
    "enrich_in_place": lambda t: enrich(_old(t), _new(t), _KEY, ["volume"]),
    "ingest_eod": ingest_eod,
    "ingest_statements": ingest_statements,
    "asof_price": asof_price,
}

_SIDES = """o AS (SELECT ticker, date, close, CASE WHEN day(date) % 2 = 0 THEN volume END AS volume FROM eod_prices WHERE date <= DATE '2001-03-31'),
    n AS (SELECT ticker, date, close + 1 AS close, CASE WHEN day(date) % 3 = 0 THEN volume + 1 END AS volume FROM eod_prices WHERE date > DATE '2001-02-28')"""
_FULL = "FROM o FULL JOIN n ON n.ticker = o.ticker AND n.date = o.date"
_ID = "coalesce(n.ticker, o.ticker) AS ticker, coalesce(n.date, o.date) AS date"
SQL = {
    "upsert": f"WITH {_SIDES} SELECT {_ID}, CASE WHEN n.ticker IS NULL THEN o.close ELSE n.close END AS close, CASE WHEN n.ticker IS NULL THEN o.volume ELSE n.volume END AS volume {_FULL}",
    "upsert_partial": f"WITH {_SIDES} SELECT {_ID}, CASE WHEN o.ticker IS NULL THEN n.close ELSE o.close END AS close, coalesce(n.volume, o.volume) AS volume {_FULL}",
    "coalescing_upsert": f"WITH {_SIDES} SELECT {_ID}, coalesce(n.close, o.close) AS close, coalesce(n.volume, o.volume) AS volume {_FULL}",
    "insert_ignore": f"WITH {_SIDES} SELECT * FROM o UNION ALL SELECT * FROM n ANTI JOIN o ON o.ticker = n.ticker AND o.date = n.date",
    "enrich_in_place": f"WITH {_SIDES} SELECT o.ticker, o.date, o.close, coalesce(nullif(o.volume, 0), n.volume, o.volume) AS volume FROM o LEFT JOIN n ON n.ticker = o.ticker AND n.date = o.date",
    "ingest_eod": "SELECT ticker, date, high, low, close, adjusted_close, volume FROM eod_prices",
    "ingest_statements": "SELECT ticker, date, 'yearly' AS period_type, filing_date, total_revenue, net_income FROM statements",
    "asof_price": "SELECT h.ticker, h.holder_name, h.report_date, e.close AS price, e.date AS price_date FROM institutional_holders h ASOF LEFT JOIN eod_prices e ON e.ticker = h.ticker AND e.date <= h.report_date",
}
