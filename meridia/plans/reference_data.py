"""Exchanges, calendars, intraday and macro series as payloads; tickers that are resolved and made sure of; the study as it is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.ordered import placed
from meridia.operators.upsert import insert_ignore
from meridia.sources.domain import AS_OF, Tables, day
from meridia.sources.ingest import SPECS, ingest, qualified, ticker_parts, without_nan
from meridia.sources.stored import StoredTable, by_bucket, by_month
from meridia.sources.workspace import new_folder, written

from .newsletter import holiday_payloads
from .payloads import _json
from .ssg import ssg_study


def ingest_exchanges(t: Tables) -> DataFrame:
    """A payload a nation; those without a code are dropped."""
    code = F.when(F.col("n_nationkey") % 9 != 4, F.upper(F.substring("n_name", 1, 4)))
    sent = t.read("nation").select(_json(Code=F.concat(code, F.col("n_nationkey").cast("string")), Name=F.initcap("n_name"), OperatingMIC=F.lit(""), Country="n_name").alias("payload"))
    return ingest(sent, SPECS["exchanges"]).select("code", "name", "operating_mic", "country")


def ingest_exchange_details(t: Tables) -> DataFrame:
    """The holidays stay JSON: exchange, time zone, and how many there are in the stored text."""
    regions = t.read("region").select("r_name").join(holiday_payloads(t))  # one calendar
    sent = regions.select(F.concat(F.lit('{"Code":"'), "r_name", F.lit('","Timezone":"UTC","ExchangeHolidays":'), "holidays", F.lit("}")).alias("payload"))
    rows = ingest(sent, SPECS["exchange_details"])
    return rows.select("exchange_code", "timezone", F.size(F.from_json("holidays", "map<string,string>")).alias("n_holidays"))


def ingest_intraday(t: Tables) -> DataFrame:
    """Bars of a second from the events, with times as text; bars without a readable time are skipped."""
    bars = t.read("events").groupBy(F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 25).cast("string")).alias("ticker"), F.date_trunc("second", "ts").alias("at"))
    rows = bars.agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("volume"))
    text = F.when(F.second("at") % 10 == 7, F.lit("no time")).otherwise(F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
    sent = rows.select("ticker", F.lit("1s").alias("interval"), _json(datetime=text, high="high", low="low", volume="volume").alias("payload"))
    return ingest(sent, SPECS["intraday_prices"]).select("ticker", "ts", "interval", "high", "low", "volume")


def _yearly(t: Tables) -> DataFrame:
    customer = t.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = t.read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    orders = t.read("orders").select("o_custkey", F.year("o_orderdate").alias("year")).join(customer, "o_custkey").join(nation, "c_nationkey")
    return orders.groupBy("n_name", "year").agg(F.count("*").alias("n"))


def ingest_macro(t: Tables) -> DataFrame:
    """Orders by country and year as an indicator."""
    date = F.concat(F.col("year").cast("string"), F.lit("-12-31"))
    sent = _yearly(t).select(_json(CountryCode="n_name", Indicator=F.lit("orders"), Date=date, Value=F.when(F.col("n") % 5 == 0, F.lit("N/A")).otherwise(F.col("n").cast("string"))).alias("payload"))
    return ingest(sent, SPECS["macro_indicators"]).select("country", "indicator", "date", "value")


def ingest_economic_events(t: Tables) -> DataFrame:
    date = F.concat(F.col("year").cast("string"), F.lit("-06-30 08:30:00"))
    sent = _yearly(t).select(_json(date=date, country="n_name", type=F.when(F.col("n") % 7 != 0, F.lit("Orders")), period=F.lit("Q2"), actual="n", estimate=F.col("n") + 1, change_percentage=F.lit("")).alias("payload"))
    return ingest(sent, SPECS["economic_events"]).select("event_date", "country", "type", "period", "actual", "estimate", "change_pct")


def ingest_ipo_calendar(t: Tables) -> DataFrame:
    """First dividends as listings."""
    first = t.dividends.groupBy("ticker").agg(F.min("ex_date").alias("d"), F.max("value").alias("top"))
    sent = first.select(_json(code="ticker", exchange=F.lit("US"), start_date=F.col("d").cast("string"), filing_date=F.lit("0000-00-00"), price_from=F.lit(1.5), offer_price="top", deal_type=F.lit("Priced")).alias("payload"))
    return ingest(sent, SPECS["ipo_calendar"]).select("code", "exchange", "start_date", "filing_date", "price_from", "offer_price", "deal_type")


def ingest_splits_calendar(t: Tables) -> DataFrame:
    sent = t.dividends.select(_json(code="ticker", exchange=F.lit("US"), split_date=F.col("ex_date").cast("string"), optionable=F.when(F.month("ex_date") == 3, "true").otherwise("no"), old_shares=F.month("ex_date"), new_shares=F.year("ex_date")).alias("payload"))
    return ingest(sent, SPECS["splits_calendar"]).select("code", "exchange", "split_date", "optionable", "old_shares", "new_shares")


def resolve_tickers(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """query, ticker: what looks like CODE.EXCHANGE, in capitals; else the best hit among symbols (ticker, code, name), null without one.

    An exact code beats one that begins with the query, and that a name with a word that does; then the shorter ticker, then the lesser. Symbols are looked up by their
    beginnings, an equi-join, so queries and symbols are never paired.
    """
    wanted = queries.select("query").distinct().withColumn("_q", F.lower(F.trim("query")))
    given = (F.col("_q") != "") & F.col("_q").contains(".") & ~F.col("_q").contains(" ")
    starts = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda k: F.substring(c, F.lit(1), k))
    codes = symbols.select("ticker", F.lower("code").alias("_c")).where("_c <> ''")
    by_code = codes.select("ticker", F.explode(starts(F.col("_c"))).alias("_q"), "_c").select("ticker", "_q", F.when(F.col("_c") == F.col("_q"), 0).otherwise(1).alias("_rank"))
    words = symbols.select("ticker", F.explode(F.split(F.lower("name"), r"\s+")).alias("_w")).where("_w <> ''")
    by_name = words.select("ticker", F.explode(starts(F.col("_w"))).alias("_q"), F.lit(2).alias("_rank"))
    hits = by_code.unionByName(by_name).join(wanted.where("_q <> ''").select("_q").distinct(), "_q", "left_semi")
    best = hits.groupBy("_q").agg(F.min(F.struct("_rank", F.length("ticker").alias("_n"), "ticker")).alias("_best"))
    found = wanted.join(best, "_q", "left")
    return found.select("query", F.when(given, F.upper(F.trim("query"))).otherwise(F.col("_best.ticker")).alias("ticker"))


def ensure_symbols(tickers: DataFrame, symbols: StoredTable, exchanges: StoredTable) -> None:
    """Inserts the symbols, and the exchanges they name, that are not stored yet; known ones stay. A ticker without a dot is an error and nothing is inserted."""
    bad = tickers.where(F.col("ticker").isNull() | ~F.col("ticker").contains(".")).select("ticker").first()
    if bad is not None:
        raise ValueError(f"ticker {bad.ticker!r} must look like CODE.EXCHANGE")
    code, exchange = ticker_parts(F.col("ticker"))
    rows = tickers.select("ticker", code.alias("code"), exchange.alias("exchange_code"), F.lit(True).alias("is_active")).distinct()
    named = rows.select(F.col("exchange_code").alias("code"), F.col("exchange_code").alias("name")).distinct()
    exchanges.merge(named, lambda old, new: insert_ignore(old, new, ["code"]))
    symbols.merge(rows, lambda old, new: insert_ignore(old, new, ["ticker"]))


def _symbols(t: Tables) -> DataFrame:
    code = F.regexp_replace("ticker", "#", "")
    return t.fundamentals.select(qualified(code, F.col("exchange")).alias("ticker"), F.upper(code).alias("code"), "name", F.col("exchange").alias("exchange_code"))


def resolved_tickers(t: Tables) -> DataFrame:
    """Every name's code, the first word of its name, a qualified form and some nothings, resolved."""
    s = _symbols(t)
    forms = [F.concat(F.lit(" "), F.lower("code")), F.substring("code", 1, 6), F.split("name", " ")[0], F.lower("ticker"), F.concat(F.col("code"), F.lit("?")), F.lit("  ")]
    return resolve_tickers(s.select(F.explode(F.array(*forms)).alias("query")), s)


def ensured_symbols(t: Tables) -> DataFrame:
    """Half of the symbols were stored before, as inactive; then all are made sure of, twice."""
    folder = new_folder(t.spark, "symbols")
    symbols, exchanges = StoredTable(t.spark, f"{folder}/symbols", by_bucket(["ticker"], 4)), StoredTable(t.spark, f"{folder}/exchanges", by_bucket(["code"], 1))
    all_ = _symbols(t)
    symbols.replace(all_.where("length(code) = 6").select("ticker", "code", "exchange_code", F.lit(False).alias("is_active")))
    for _ in range(2):
        ensure_symbols(all_, symbols, exchanges)
    known = exchanges.read().select(F.col("code").alias("exchange_code"), F.col("name").alias("exchange"))
    return symbols.read().join(known, "exchange_code", "left").select("ticker", "code", "exchange_code", "exchange", "is_active")


def appended_prices(t: Tables) -> DataFrame:
    """Prices that came in three batches, each added to the files of the others: months and rows."""
    table = StoredTable(t.spark, new_folder(t.spark, "batches"), by_month("date"))
    for k in range(3):
        table.append(t.eod_prices.where(F.day("date") % 3 == k))
    rows = table.read()
    return rows.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


def store_study(study: DataFrame, table: StoredTable, issue_date: str = AS_OF) -> None:
    """The study over the rows of its day, best first, infinities and not-a-numbers as nulls. A second run of a day replaces the first."""
    ranked = placed(without_nan(study), [F.desc_nulls_last("total_return"), F.asc("ticker")])
    rows = ranked.withColumn("place", F.col("_place").cast("int")).drop("_place", "_n")
    table.replace(rows.withColumn("issue_date", day(issue_date)))


def stored_study(t: Tables) -> DataFrame:
    table = StoredTable(t.spark, new_folder(t.spark, "study"), F.col("issue_date").cast("string"))
    study = written(ssg_study(t), "study")
    for date in ("2001-03-31", AS_OF, AS_OF):
        store_study(study, table, date)
    return table.read().select("issue_date", "place", "ticker", "total_return")


PLANS = {
    f.__name__: f
    for f in (
        ingest_exchanges, ingest_exchange_details, ingest_intraday, ingest_macro, ingest_economic_events, ingest_ipo_calendar, ingest_splits_calendar,
        resolved_tickers, ensured_symbols, appended_prices, stored_study,
    )
}

_SYMBOLS = "SELECT upper(replace(ticker, '#', '')) || '.' || upper(exchange) AS ticker, upper(replace(ticker, '#', '')) AS code, name, exchange AS exchange_code FROM fundamentals"
_YEARLY = "SELECT n_name, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2"
SQL = {
    "ingest_exchanges": "SELECT upper(n_name[1:4]) || n_nationkey AS code, upper(n_name[1]) || lower(n_name[2:]) AS name, NULL::VARCHAR AS operating_mic, n_name AS country FROM nation WHERE n_nationkey % 9 <> 4",
    "ingest_exchange_details": "SELECT r_name AS exchange_code, 'UTC' AS timezone, (SELECT CAST(count(*) AS INTEGER) FROM nation) AS n_holidays FROM region",
    "ingest_intraday": """SELECT 'Brand#' || (1 + user_id % 25) AS ticker, date_trunc('second', ts) AS ts, '1s' AS interval, max(value) AS high, min(value) AS low, count(*) AS volume
      FROM events WHERE second(ts) % 10 <> 7 GROUP BY 1, 2""",
    "ingest_macro": f"SELECT n_name AS country, 'orders' AS indicator, make_date(year, 12, 31) AS date, CASE WHEN n % 5 <> 0 THEN CAST(n AS DOUBLE) END AS value FROM ({_YEARLY})",
    "ingest_economic_events": f"""SELECT CAST(make_date(year, 6, 30) AS TIMESTAMP) + INTERVAL 510 MINUTE AS event_date, n_name AS country, 'Orders' AS type, 'Q2' AS period, CAST(n AS DOUBLE) AS actual,
        CAST(n + 1 AS DOUBLE) AS estimate, NULL::DOUBLE AS change_pct FROM ({_YEARLY}) WHERE n % 7 <> 0""",
    "ingest_ipo_calendar": """SELECT ticker AS code, 'US' AS exchange, min(ex_date) AS start_date, NULL::DATE AS filing_date, 1.5::DOUBLE AS price_from, max(value) AS offer_price, 'Priced' AS deal_type
      FROM dividends GROUP BY ticker""",
    "ingest_splits_calendar": """SELECT ticker AS code, 'US' AS exchange, ex_date AS split_date, month(ex_date) = 3 AS optionable, CAST(month(ex_date) AS DOUBLE) AS old_shares, CAST(year(ex_date) AS DOUBLE) AS new_shares
      FROM dividends""",
    "resolved_tickers": f"""WITH s AS ({_SYMBOLS}),
      q AS (SELECT DISTINCT unnest([' ' || lower(code), code[1:6], split_part(name, ' ', 1), lower(ticker), code || '?', '  ']) AS query FROM s),
      k AS (SELECT query, lower(trim(query)) AS t FROM q),
      h AS (SELECT k.query, s.ticker, CASE WHEN lower(s.code) = t THEN 0 WHEN starts_with(lower(s.code), t) THEN 1 ELSE 2 END AS rank
            FROM k JOIN s ON t <> '' AND (starts_with(lower(s.code), t) OR len(list_filter(string_split(lower(s.name), ' '), lambda w: starts_with(w, t))) > 0)),
      b AS (SELECT query, ticker FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, length(ticker), ticker) = 1)
      SELECT k.query, CASE WHEN t <> '' AND contains(t, '.') AND NOT contains(t, ' ') THEN upper(t) ELSE b.ticker END AS ticker FROM k LEFT JOIN b ON b.query = k.query""",
    "ensured_symbols": f"SELECT ticker, code, exchange_code, exchange_code AS exchange, length(code) <> 6 AS is_active FROM ({_SYMBOLS})",
    "appended_prices": "SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM eod_prices GROUP BY 1",
}


def study_sql(study: str) -> str:
    """study is the study's own SQL."""
    return f"""SELECT of_day AS issue_date, CAST(row_number() OVER (PARTITION BY of_day ORDER BY total_return DESC NULLS LAST, ticker) AS INTEGER) AS place, ticker, total_return
      FROM ({study}) s, (VALUES (DATE '2001-03-31'), (DATE '2001-06-30')) d(of_day)"""
