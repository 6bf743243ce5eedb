"""Payload ingestion over the derived tables: each is turned into payload text and read back, so SQL can tell what must come out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.upsert import update_from_entries, upsert_partial
from meridia.sources.domain import Tables
from meridia.sources.ingest import SPECS, explode_options, fan_out, ingest, ingest_insider, upsert_roster


def _json(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in fields.items()]))


def _day(c: str) -> Column:
    return F.col(c).cast("string")


def _entry(key: Column, value: Column) -> Column:
    return F.concat(F.lit('"'), key, F.lit('":'), value)


def _assembled(parts: dict[str, DataFrame]) -> DataFrame:
    """ticker and a column a part: its texts in order, with commas between; null where a ticker has none. Parts have the columns ticker and text.

    All parts are one union, and a ticker's texts meet by shuffles alone: joined part by part they were taken for small, as they have few rows, and sent whole to the driver.
    """
    rows = reduce(DataFrame.unionByName, [df.select("ticker", F.lit(name).alias("part"), "text") for name, df in parts.items()])
    lists = rows.groupBy("ticker", "part").agg(F.array_join(F.sort_array(F.collect_list("text")), ",").alias("texts"))
    return lists.groupBy("ticker").agg(*[F.max(F.when(F.col("part") == name, F.col("texts"))).alias(name) for name in parts])


def fundamentals_payloads(t: Tables) -> DataFrame:
    """A payload a ticker with everything that fan_out() looks for. Half of the tickers have the flat form of estimates."""
    filed = F.coalesce(_day("filing_date"), F.lit("0000-00-00"))
    income = _json(date=F.lit("1900-01-01"), totalRevenue="total_revenue", incomeBeforeTax="income_before_tax", netIncome="net_income")
    balance = _json(filing_date=filed, totalAssets="total_assets", cash="cash", longTermDebt="long_term_debt")
    flow = _json(filing_date=filed, freeCashFlow="free_cash_flow", totalCashFromOperatingActivities="operating_cash_flow")
    history = _json(date=_day("date"), epsActual="eps_actual", epsEstimate="eps_estimate", surprisePercent="surprise_pct")
    trend = _json(date=_day("date"), period="period", growth="growth")
    holder = _json(name="holder_name", date=_day("report_date"), currentShares="shares_held", totalShares="pct_shares", change="change_shares", change_p="change_pct")
    place = F.concat_ws("|", "holder_name", _day("report_date"))
    shares = _json(dateFormatted=_day("date"), shares="shares")
    general = _json(Name="name", Sector="sector", Type="type", IsDelisted="is_delisted")
    highlights = _json(MarketCapitalization="market_cap", PERatio="pe_ratio", ReturnOnEquityTTM="return_on_equity", DividendYield="dividend_yield")
    texts = {
        "general": (t.fundamentals, general), "highlights": (t.fundamentals, highlights),
        "income": (t.growth_statements, _entry(_day("date"), income)), "balance": (t.statements, _entry(_day("date"), balance)), "flow": (t.statements, _entry(_day("date"), flow)),
        "history": (t.earnings_history, _entry(_day("report_date"), history)), "trend": (t.earnings_trend, _entry(F.concat_ws("|", _day("date"), "period"), trend)),
        "inst": (t.institutional_holders, _entry(place, holder)), "fund": (t.fund_holders, _entry(place, holder)), "shares": (t.statements, _entry(_day("date"), shares)),
    }
    rows = _assembled({name: df.select("ticker", text.alias("text")) for name, (df, text) in texts.items()}).where("general is not null")
    block = lambda name: F.concat(F.lit("{"), F.coalesce(name, F.lit("")), F.lit("}"))
    estimates = F.when(F.substring("ticker", 7, 9).cast("int") % 2 == 0, F.concat(F.lit('{"Annual":'), block("trend"), F.lit("}"))).otherwise(block("trend"))
    text = [
        ('{"General":', F.col("general")), (',"Highlights":', F.col("highlights")), (',"Financials":{"Income_Statement":{"yearly":', block("income")),
        ('},"Balance_Sheet":{"yearly":', block("balance")), ('},"Cash_Flow":{"quarterly":', block("flow")), ('}},"Earnings":{"History":', block("history")),
        (',"Trend":', estimates), ('},"outstandingShares":{"annual":', block("shares")), ('},"Holders":{"Institutions":', block("inst")), (',"Funds":', block("fund")),
    ]
    return rows.select("ticker", F.concat(*[p for label, value in text for p in (F.lit(label), value)], F.lit("}}")).alias("payload"))


def _fanned(t: Tables, name: str, *columns: str) -> DataFrame:
    return fan_out(fundamentals_payloads(t))[name].select(*columns)


def ingest_fundamentals(t: Tables) -> DataFrame:
    blocks = [(F.length("holders") > 2).alias("has_holders"), "esg_scores"]
    return _fanned(t, "fundamentals", "ticker", "name", "sector", "asset_type", "is_delisted", "market_cap", "pe_ratio", "return_on_equity", "dividend_yield", *blocks)


def ingest_income(t: Tables) -> DataFrame:
    """Rows that were there keep their first figures; only their raw text is the new one."""
    new = _fanned(t, "income_statements", "ticker", "date", "period_type", "total_revenue", "income_before_tax", "net_income", "raw")
    first = t.growth_statements.where("year(date) < 1996").select("ticker", "date", F.lit("yearly").alias("period_type"), (F.col("total_revenue") + 1).alias("total_revenue"), "income_before_tax", "net_income", F.lit("{}").alias("raw"))
    keys = ["ticker", "date", "period_type"]
    return upsert_partial(first, new, keys, ["raw"]).withColumn("raw", F.length("raw") > 2)


def ingest_balance(t: Tables) -> DataFrame:
    return _fanned(t, "balance_sheets", "ticker", "date", "period_type", "filing_date", "total_assets", "cash", "long_term_debt")


def ingest_cash_flow(t: Tables) -> DataFrame:
    return _fanned(t, "cash_flow_statements", "ticker", "date", "period_type", "filing_date", "operating_cash_flow", "free_cash_flow")


def ingest_earnings_history(t: Tables) -> DataFrame:
    return _fanned(t, "earnings_history", "ticker", "report_date", "date", "eps_actual", "eps_estimate", "surprise_pct")


def ingest_earnings_trend(t: Tables) -> DataFrame:
    return _fanned(t, "earnings_trend", "ticker", "date", "period", "growth")


def ingest_shares(t: Tables) -> DataFrame:
    return _fanned(t, "shares_outstanding", "ticker", "date", "frequency", "shares")


def ingest_institutions(t: Tables) -> DataFrame:
    return _fanned(t, "institutional_holders", "ticker", "holder_name", "report_date", "shares_held", "pct_shares", "change_shares", "change_pct")


def ingest_funds(t: Tables) -> DataFrame:
    return _fanned(t, "fund_holders", "ticker", "holder_name", "report_date", "shares_held", "pct_shares", "change_shares", "change_pct")


def backfill_changes(t: Tables) -> DataFrame:
    """Fund holders of some names that lost their changes get them from the stored block."""
    lost = F.length("ticker") % 2 == 0
    keep = lambda c: F.when(~lost, F.col(c)).alias(c)
    old = t.fund_holders.select("ticker", "holder_name", "report_date", "shares_held", keep("change_shares"), keep("change_pct"))
    blocks = fan_out(fundamentals_payloads(t))["fundamentals"].select("ticker", "holders")
    keyed, fields = {"holder_name": "name", "report_date": "date"}, {"change_shares": "change", "change_pct": "change_p"}
    return update_from_entries(old, blocks, ["ticker", "holder_name", "report_date"], "holders", "Funds", fields, keyed)


def ingest_insider_chain(t: Tables) -> DataFrame:
    """Old rows without shares or value are completed, new ones come in."""
    by = ["ticker", "transaction_date", "owner_name", "transaction_code"]
    first = F.row_number().over(Window.partitionBy(*by).orderBy("event_id"))
    rows = t.insider_transactions.withColumn("first", first).where("first = 1")
    sent = rows.select("ticker", _json(transactionDate=_day("transaction_date"), ownerName="owner_name", ownerTitle="relationship", transactionCode="transaction_code", transactionAmount="shares", transactionPrice="price", reportDate=_day("report_date")).alias("payload"))
    none = lambda kind: F.lit(None).cast(kind)
    old = rows.where("event_id % 4 = 0").select(
        "ticker", "transaction_date", none("string").alias("owner_cik"), "owner_name", none("string").alias("relationship"), "transaction_code", none("string").alias("acquisition_or_disposition"),
        F.lit(0.0).alias("shares"), "price", none("double").alias("value"), none("date").alias("report_date"), none("string").alias("owner_title"),
    )
    columns = [*by, "shares", "price", "value", "report_date", "relationship", "owner_title"]
    return ingest_insider(old, sent).select(*columns)


def ingest_options(t: Tables) -> DataFrame:
    """Two chains a ticker, seen on two days; strikes are closes."""
    strikes = t.eod_prices.select("ticker", "date", "close", "volume")
    contract = F.sort_array(F.collect_list(_json(strike="close", volume="volume", lastPrice=F.lit(1.5), impliedVolatility=F.lit("N/A"))))
    by = strikes.groupBy("ticker", "date").agg(F.concat(F.lit("["), F.array_join(contract, ","), F.lit("]")).alias("c"))
    chain = F.concat(F.lit('{"expirationDate":"'), _day("date"), F.lit('","options":{"CALL":'), "c", F.lit(',"PUT":'), "c", F.lit(',"OTHER":[{}]}}'))
    text = by.groupBy("ticker").agg(F.array_join(F.sort_array(F.collect_list(chain)), ",").alias("all"))
    seen = F.explode(F.array(F.lit("2001-07-01"), F.lit("2001-07-02"))).alias("snapshot_date")
    payloads = text.select("ticker", seen, F.concat(F.lit('{"data":['), "all", F.lit("]}")).alias("payload"))
    return ingest(explode_options(payloads), SPECS["options_chains"]).select("ticker", "snapshot_date", "expiration_date", "option_type", "strike", "last", "volume", "implied_volatility", "in_the_money")


def ingest_symbols(t: Tables) -> DataFrame:
    code, exchange = F.regexp_replace("ticker", "#", "_"), F.col("exchange")
    sent = t.fundamentals.select(_json(Code=code, Exchange=exchange, Name="name", Type="type", ISIN=F.concat(F.lit("US"), code)).alias("payload"))
    return ingest(sent.unionByName(sent.select(F.lit('{"Name":"without a code"}').alias("payload"))), SPECS["symbols"]).select("ticker", "code", "exchange_code", "name", "type", "isin")


def ingest_roster(t: Tables) -> DataFrame:
    """A roster of delisted names over the symbols: the day of delisting stands under one of several names, or is missing."""
    n = F.substring("ticker", 7, 9).cast("int")
    code = F.concat(F.lit("B"), n.cast("string"))
    old = t.fundamentals.where("not is_delisted").select(
        F.concat(code, F.lit(".US")).alias("ticker"), code.alias("code"), F.lit("US").alias("exchange_code"), "name", F.lit(True).alias("is_active"), F.when(n % 4 == 0, F.lit("1999-01-01").cast("date")).alias("delisted_on")
    )
    first, second = F.when(n % 8 == 5, F.lit("2000-06-30")).otherwise("0000-00-00"), F.when(n % 8 == 1, F.lit("2000-09-30T00:00"))
    sent = t.fundamentals.where(n % 2 == 1).select(F.lit("US").alias("exchange"), F.lit("true").alias("delisted"), _json(Code=code, Exchange=F.lit("NYSE"), Name=F.upper("name"), DelistedDate=first, DelistDate=second).alias("payload"))
    return upsert_roster(old, sent)


def ingest_splits(t: Tables) -> DataFrame:
    sent = t.dividends.select("ticker", _json(date=_day("ex_date"), split=F.concat_ws("/", F.year("ex_date").cast("string"), F.month("ex_date").cast("string"))).alias("payload"))
    return ingest(sent, SPECS["splits"]).select("ticker", "date", "numerator", "denominator")


def ingest_earnings_calendar(t: Tables) -> DataFrame:
    sent = t.earnings_history.select(_json(code="ticker", report_date=_day("report_date"), date=_day("date"), actual="eps_actual", estimate="eps_estimate", percent="surprise_pct").alias("payload"))
    return ingest(sent, SPECS["earnings_calendar"]).select("ticker", "report_date", "date", "eps_actual", "eps_estimate", "surprise_pct")


def ingest_dividends(t: Tables) -> DataFrame:
    sent = t.dividends.select("ticker", _json(date=_day("ex_date"), value="value", currency=F.lit("USD"), paymentDate=F.lit("0000-00-00")).alias("payload"))
    return ingest(sent, SPECS["dividends"]).select("ticker", "ex_date", "value", "currency", "payment_date")


def ingest_news(t: Tables) -> DataFrame:
    """Stories by id; each is sent twice."""
    sent = t.news.select(_json(id=F.col("event_id").cast("string"), ticker="ticker", title="title", symbols="symbols", date=F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), polarity="sentiment_polarity").alias("payload"))
    return ingest(sent.unionByName(sent), SPECS["news"]).select("uuid", "ticker", "title", F.array_join("symbols", ",").alias("symbols"), "sentiment_polarity")


def ingest_sentiment(t: Tables) -> DataFrame:
    sent = t.sentiment_daily.select("ticker", _json(date=_day("date"), count="count", normalized="normalized").alias("payload"))
    return ingest(sent, SPECS["sentiment_daily"]).select("ticker", "date", "count", "normalized")


def ingest_quotes(t: Tables) -> DataFrame:
    """Epoch seconds; the last quote of a ticker stands."""
    sent = t.eod_prices.select(F.unix_date("date").alias("seen"), _json(code="ticker", timestamp=F.unix_date("date") * 86400, close="close", volume="volume", change_p=F.lit("N/A")).alias("payload"))
    return ingest(sent, SPECS["realtime_quotes"], order="seen").select("ticker", "ts", "close", "volume", "change_pct")


PLANS = {
    f.__name__: f
    for f in (
        ingest_fundamentals, ingest_income, ingest_balance, ingest_cash_flow, ingest_earnings_history, ingest_earnings_trend, ingest_shares, ingest_institutions, ingest_funds, backfill_changes, ingest_insider_chain,
        ingest_options, ingest_symbols, ingest_roster, ingest_splits, ingest_earnings_calendar, ingest_dividends, ingest_news, ingest_sentiment, ingest_quotes,
    )
}

_HOLDERS = "ticker, holder_name, report_date, shares_held, pct_shares, change_shares, change_pct"
_KEY = "ticker, transaction_date, owner_name, transaction_code"
SQL = {
    "ingest_fundamentals": "SELECT ticker, name, sector, type AS asset_type, is_delisted, market_cap, pe_ratio, return_on_equity, dividend_yield, true AS has_holders, '{}' AS esg_scores FROM fundamentals",
    "ingest_income": "SELECT ticker, date, 'yearly' AS period_type, CASE WHEN year(date) < 1996 THEN total_revenue + 1 ELSE total_revenue END AS total_revenue, income_before_tax, net_income, true AS raw FROM growth_statements",
    "ingest_balance": "SELECT ticker, date, 'yearly' AS period_type, filing_date, total_assets, cash, long_term_debt FROM statements",
    "ingest_cash_flow": "SELECT ticker, date, 'quarterly' AS period_type, filing_date, operating_cash_flow, free_cash_flow FROM statements",
    "ingest_earnings_history": "SELECT ticker, report_date, date, eps_actual, eps_estimate, surprise_pct FROM earnings_history",
    "ingest_earnings_trend": "SELECT ticker, date, period, growth FROM earnings_trend",
    "ingest_shares": "SELECT ticker, date, 'annual' AS frequency, shares FROM statements",
    "ingest_institutions": f"SELECT {_HOLDERS} FROM institutional_holders",
    "ingest_funds": f"SELECT {_HOLDERS} FROM fund_holders",
    "backfill_changes": "SELECT ticker, holder_name, report_date, shares_held, change_shares, CASE WHEN length(ticker) % 2 = 0 AND change_shares IS NULL THEN NULL ELSE change_pct END AS change_pct FROM fund_holders",
    "ingest_insider_chain": f"""WITH r AS (SELECT * FROM insider_transactions QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY event_id) = 1),
      n AS (SELECT {_KEY}, shares, price, shares * price AS value, report_date, NULL::VARCHAR AS relationship, relationship AS owner_title, event_id FROM r)
      SELECT * EXCLUDE (event_id) FROM n UNION ALL SELECT * EXCLUDE (event_id) FROM n WHERE event_id % 4 = 0""",
    "ingest_options": """SELECT ticker, s AS snapshot_date, date AS expiration_date, o AS option_type, close AS strike, 1.5::DOUBLE AS last, volume, NULL::DOUBLE AS implied_volatility, false AS in_the_money
      FROM eod_prices, (VALUES (DATE '2001-07-01'), (DATE '2001-07-02')) d(s), (VALUES ('CALL'), ('PUT')) k(o)""",
    "ingest_symbols": "SELECT replace(ticker, '#', '_') || '.' || exchange AS ticker, replace(ticker, '#', '_') AS code, exchange AS exchange_code, name, type, 'US' || replace(ticker, '#', '_') AS isin FROM fundamentals",
    "ingest_roster": """WITH f AS (SELECT *, CAST(substr(ticker, 7) AS INTEGER) AS n FROM fundamentals)
      SELECT 'B' || n || '.US' AS ticker, 'B' || n AS code, CASE WHEN n % 2 = 1 THEN 'NYSE' ELSE 'US' END AS exchange_code, CASE WHEN n % 2 = 1 THEN upper(name) ELSE name END AS name, n % 2 = 0 AS is_active,
        CASE WHEN n % 8 = 5 THEN DATE '2000-06-30' WHEN n % 8 = 1 THEN DATE '2000-09-30' WHEN n % 4 = 0 THEN DATE '1999-01-01' END AS delisted_on FROM f WHERE n % 2 = 1 OR NOT is_delisted""",
    "ingest_splits": "SELECT ticker, ex_date AS date, CAST(year(ex_date) AS DOUBLE) AS numerator, CAST(month(ex_date) AS DOUBLE) AS denominator FROM dividends",
    "ingest_earnings_calendar": "SELECT ticker, report_date, date, eps_actual, eps_estimate, surprise_pct FROM earnings_history",
    "ingest_dividends": "SELECT ticker, ex_date, value, 'USD' AS currency, NULL::DATE AS payment_date FROM dividends",
    "ingest_news": "SELECT CAST(event_id AS VARCHAR) AS uuid, ticker, title, array_to_string(symbols, ',') AS symbols, sentiment_polarity FROM news",
    "ingest_sentiment": "SELECT ticker, date, count, normalized FROM sentiment_daily",
    "ingest_quotes": """SELECT ticker, CAST(max(date) AS TIMESTAMP) AS ts, arg_max(close, date) AS close, arg_max(volume, date) AS volume, NULL::DOUBLE AS change_pct FROM eod_prices GROUP BY ticker""",
}
