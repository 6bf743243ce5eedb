"""Reads of the dashboard: range scans, last rows of a ticker, top holders, labelled overview. Filters reach the scan."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.numbers import shown_big, shown_number, shown_percent
from meridia.sources.domain import Tables, day
from meridia.sources.ingest import fan_out

from .oracle import R
from .payloads import fundamentals_payloads, ingest_splits
from .strategies import checked

TICKER = "Brand#7"


def price_range(t: Tables, ticker: str = TICKER, start: str = "2000-01-01", end: str = "2000-12-31") -> DataFrame:
    return t.eod_prices.where((F.col("ticker") == ticker) & F.col("date").between(day(start), day(end)))


def _last(df: DataFrame, ticker: str, by: str, n: int, *ties: str) -> DataFrame:
    return df.where(F.col("ticker") == ticker).orderBy(F.desc(by), *ties).limit(n)


#: Columns of each kind of statement.
STATEMENTS = {
    "income": ["total_revenue", "gross_profit", "net_income", "ebitda"],
    "balance": ["total_assets", "total_current_assets", "total_current_liabilities", "long_term_debt", "total_stockholder_equity", "cash", "shares"],
    "cashflow": ["free_cash_flow", "operating_cash_flow"],
}


def financials(t: Tables, ticker: str = TICKER, statement: str | None = None) -> DataFrame:
    """The last statements of one kind, or of all kinds."""
    if statement is None:
        return _last(t.statements, ticker, "date", 10)
    kind = checked({"statement": statement}, {"statement": list(STATEMENTS)})["statement"]
    return _last(t.statements.select("ticker", "date", "filing_date", *STATEMENTS[kind]), ticker, "date", 10)


def splits_history(t: Tables, ticker: str = TICKER) -> DataFrame:
    return _last(ingest_splits(t), ticker, "date", 1000)


def earnings_recent(t: Tables, ticker: str = TICKER) -> DataFrame:
    return _last(t.earnings_history, ticker, "report_date", 24)


def dividend_history(t: Tables, ticker: str = TICKER) -> DataFrame:
    return _last(t.dividends, ticker, "ex_date", 1000)


def insider_recent(t: Tables, ticker: str = TICKER) -> DataFrame:
    return _last(t.insider_transactions, ticker, "transaction_date", 100, "event_id")


def top_holders(t: Tables, ticker: str = TICKER, n: int = 50) -> DataFrame:
    """Institutions and funds by share of the company, nulls last."""
    columns = ["ticker", "holder_name", "report_date", "shares_held", "pct_shares", "change_shares"]
    one = lambda df, kind: df.where(F.col("ticker") == ticker).select(F.lit(kind).alias("kind"), *columns).orderBy(F.desc_nulls_last("pct_shares"), "holder_name").limit(n)
    return one(t.institutional_holders, "institution").unionByName(one(t.fund_holders, "fund"))


# What the overview of a company shows: label, column, and how.
OVERVIEW = (
    ("Sector", "sector", "text"), ("Industry", "industry", "text"), ("Country", "country", "text"), ("Currency", "currency", "text"), ("Exchange (primary)", "primary_ticker", "text"),
    ("ISIN", "isin", "text"), ("CIK", "cik", "text"), ("IPO date", "ipo_date", "text"), ("Fiscal year end", "fiscal_year_end", "text"), ("Web URL", "web_url", "text"),
    ("Market cap", "market_cap", "big"), ("EBITDA", "ebitda", "big"), ("P/E", "pe_ratio", "number"), ("PEG", "peg_ratio", "number"), ("EPS", "eps", "number"), ("Book value", "book_value", "number"),
    ("Dividend / share", "dividend_share", "number"), ("Dividend yield", "dividend_yield", "percent"), ("Profit margin", "profit_margin", "percent"), ("Operating margin", "operating_margin", "percent"),
    ("ROA", "return_on_assets", "percent"), ("ROE", "return_on_equity", "percent"), ("Revenue TTM", "revenue_ttm", "big"), ("Gross profit TTM", "gross_profit_ttm", "big"),
    ("Q rev growth (YoY)", "quarterly_revenue_growth", "percent"), ("Q earnings growth (YoY)", "quarterly_earnings_growth", "percent"), ("WS target price", "wall_street_target_price", "number"),
)
_SHOWN = {"text": lambda c: F.nullif(c.cast("string"), F.lit("")), "number": shown_number, "percent": shown_percent, "big": shown_big}


def overview(t: Tables, ticker: str = TICKER, header: DataFrame | None = None) -> DataFrame:
    """What a company's header has of OVERVIEW, as label and value rows; fields without a value are left out."""
    header = t.fundamentals if header is None else header
    value = lambda c, how: F.when(F.col(c).isNotNull(), _SHOWN[how](F.col(c)))
    shown = [F.struct(F.lit(label).alias("label"), value(c, how).alias("value")) for label, c, how in OVERVIEW if c in header.columns]
    rows = header.where(F.col("ticker") == ticker).select("ticker", F.explode(F.array(*shown)).alias("r"))
    return rows.select("ticker", "r.label", "r.value").where("value is not null")


def json_table(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, item, key, value of a JSON text: an object is item 0, an array has an item for each of its objects; values are cut at 200."""
    text = F.trim(column)
    items = F.when(text.startswith("["), F.from_json(text, "array<map<string,string>>")).when(text.startswith("{"), F.array(F.from_json(text, "map<string,string>")))
    opened = df.select(*keys, F.posexplode(items).alias("item", "_m")).select(*keys, "item", F.explode("_m").alias("key", "value"))
    return opened.withColumn("value", F.substring("value", 1, 200))


def general_block(t: Tables) -> DataFrame:
    """The stored block of general data, as a table."""
    return json_table(fan_out(fundamentals_payloads(t))["fundamentals"], "general", ["ticker"])


PLANS = {f.__name__: f for f in (price_range, financials, splits_history, earnings_recent, dividend_history, insider_recent, top_holders, overview, general_block)}
PLANS |= {f"financials_{kind}": partial(financials, statement=kind) for kind in STATEMENTS}


def _N(e: str) -> str:
    return f"format('{{:,.2f}}', {R(e, 2)})"


_T = f"ticker = '{TICKER}'"
_H = "ticker, holder_name, report_date, shares_held, pct_shares, change_shares"
SQL = {
    "price_range": f"SELECT * FROM eod_prices WHERE {_T} AND date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'",
    "financials": f"SELECT * FROM statements WHERE {_T} ORDER BY date DESC LIMIT 10",
    "earnings_recent": f"SELECT * FROM earnings_history WHERE {_T} ORDER BY report_date DESC LIMIT 24",
    "dividend_history": f"SELECT * FROM dividends WHERE {_T} ORDER BY ex_date DESC LIMIT 1000",
    "insider_recent": f"SELECT * FROM insider_transactions WHERE {_T} ORDER BY transaction_date DESC, event_id LIMIT 100",
    "top_holders": f"""(SELECT 'institution' AS kind, {_H} FROM institutional_holders WHERE {_T} ORDER BY pct_shares DESC NULLS LAST, holder_name LIMIT 50)
      UNION ALL (SELECT 'fund' AS kind, {_H} FROM fund_holders WHERE {_T} ORDER BY pct_shares DESC NULLS LAST, holder_name LIMIT 50)""",
    "splits_history": f"SELECT ticker, ex_date AS date, CAST(year(ex_date) AS DOUBLE) AS numerator, CAST(month(ex_date) AS DOUBLE) AS denominator FROM dividends WHERE {_T} ORDER BY ex_date DESC LIMIT 1000",
    **{f"financials_{kind}": f"SELECT ticker, date, filing_date, {', '.join(columns)} FROM statements WHERE {_T} ORDER BY date DESC LIMIT 10" for kind, columns in STATEMENTS.items()},
    "general_block": """SELECT ticker, 0 AS item, k AS key, v AS value FROM (SELECT ticker, unnest(['Name', 'Sector', 'Type', 'IsDelisted']) AS k, unnest([name, sector, type, CAST(is_delisted AS VARCHAR)]) AS v FROM fundamentals) WHERE v IS NOT NULL""",
    "overview": f"""SELECT ticker, label, value FROM (SELECT ticker, unnest(['Sector', 'Industry', 'Market cap', 'P/E', 'PEG', 'Dividend yield', 'Profit margin', 'ROE', 'Q rev growth (YoY)', 'Q earnings growth (YoY)']) AS label,
        unnest([sector, industry, CASE WHEN market_cap >= 1e12 THEN {_N('market_cap / 1e12')} || 'T' WHEN market_cap >= 1e9 THEN {_N('market_cap / 1e9')} || 'B' WHEN market_cap >= 1e6 THEN {_N('market_cap / 1e6')} || 'M'
          WHEN market_cap >= 1e3 THEN {_N('market_cap / 1e3')} || 'K' ELSE {_N('market_cap')} END, {_N('pe_ratio')}, {_N('peg_ratio')},
          {", ".join(f"{_N(f'{c} * 100')} || '%'" for c in ("dividend_yield", "profit_margin", "return_on_equity", "quarterly_revenue_growth", "quarterly_earnings_growth"))}]) AS value
      FROM fundamentals WHERE {_T}) WHERE value IS NOT NULL""",
}
