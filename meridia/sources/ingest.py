"""Landing-zone payloads to typed tables: one declaration a table, one transformation for all.

A payload is JSON text. A field is looked up under several spellings, cleaned (empty text, 'N/A', '0000-00-00',
NaN and infinities are null) and typed; rows without their key fields are dropped; of rows of one key the
last payload stands. Nested payloads are opened with explode before that; a spelling 'Section.Field' looks
into an object of the payload.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.numbers import to_date, to_integer, to_number
from meridia.operators.upsert import coalescing_upsert, enrich, insert_ignore, upsert

KINDS = {
    "text": lambda c: F.nullif(F.trim(c), F.lit("")),
    "date": to_date,
    "number": to_number,
    "integer": to_integer,
    "boolean": lambda c: F.lower(c).isin("true", "1", "t", "yes"),
    "flag": lambda c: F.coalesce(F.lower(c).isin("true", "1", "t", "yes"), F.lit(False)),
    "timestamp": lambda c: F.coalesce(F.timestamp_seconds(to_integer(c)), F.try_to_timestamp(c)),
    "texts": lambda c: F.from_json(c, "array<string>"),
    "json": lambda c: c,
    "block": lambda c: F.coalesce(c, F.lit("{}")),
}


@dataclass(frozen=True)
class Spec:
    """Columns as {name: (kind, spellings)}; a column without spellings is found under its own name, '@' is the payload itself.

    derived are further columns, or such that replace one, from those; they may be keys.
    """

    keys: tuple[str, ...]
    columns: dict[str, tuple]
    derived: dict[str, Callable[[], Column]] = field(default_factory=dict)


def _fields(*groups: tuple[str, str]) -> dict[str, tuple]:
    """Groups of (kind, 'name name=Spelling|Other ...')."""
    out: dict[str, tuple] = {}
    for kind, names in groups:
        for item in names.split():
            name, _, spellings = item.partition("=")
            out[name] = (kind, tuple(spellings.split("|")) if spellings else (name,))
    return out


SPECS = {
    "exchanges": Spec(("code",), _fields(("text", "code=Code name=Name operating_mic=OperatingMIC country=Country currency=Currency country_iso2=CountryISO2"))),
    "exchange_details": Spec(("exchange_code",), _fields(("text", "exchange_code=Code|exchange_code timezone=Timezone"), ("json", "trading_hours=TradingHours holidays=ExchangeHolidays"))),
    "symbols": Spec(
        ("ticker",),
        _fields(("text", "ticker code=Code exchange_code=Exchange name=Name country=Country currency=Currency type=Type isin=Isin|ISIN")),
        {"ticker": lambda: F.coalesce("ticker", F.when(F.col("code").isNotNull() & F.col("exchange_code").isNotNull(), F.concat_ws(".", "code", "exchange_code")))},
    ),
    "roster": Spec(
        ("ticker",),
        _fields(
            ("text", "code=Code exchange exchange_code=Exchange name=Name country=Country currency=Currency type=Type isin=Isin|ISIN"), ("flag", "delisted"),
            ("date", "on_1=DelistedDate on_2=delisted_on on_3=DelistDate on_4=delisted_date"),
        ),
        {
            "ticker": lambda: F.when(F.col("code").isNotNull() & F.col("exchange").isNotNull(), F.concat_ws(".", "code", "exchange")),
            "is_active": lambda: ~F.col("delisted"),
            "delisted_on": lambda: F.when(F.col("delisted"), F.coalesce("on_1", "on_2", "on_3", "on_4")),
        },
    ),
    "eod_prices": Spec(("ticker", "date"), _fields(("text", "ticker"), ("date", "date"), ("number", "open high low close adjusted_close"), ("integer", "volume"))),
    "intraday_prices": Spec(("ticker", "ts", "interval"), _fields(("text", "ticker interval"), ("timestamp", "ts=datetime|timestamp"), ("number", "open high low close"), ("integer", "volume"))),
    "realtime_quotes": Spec(("ticker",), _fields(("text", "ticker=code|ticker"), ("timestamp", "ts=timestamp"), ("number", "open high low close previous_close=previousClose change change_pct=change_p"), ("integer", "volume"))),
    "dividends": Spec(("ticker", "ex_date"), _fields(("text", "ticker period currency"), ("date", "ex_date=date declaration_date=declarationDate record_date=recordDate payment_date=paymentDate"), ("number", "value unadjusted_value=unadjustedValue"))),
    "splits": Spec(("ticker", "date"), _fields(("text", "ticker split_text=split"), ("date", "date")), {"numerator": lambda: split_ratio(F.col("split_text"))[0], "denominator": lambda: split_ratio(F.col("split_text"))[1]}),
    "earnings_history": Spec(("ticker", "report_date"), _fields(("text", "ticker before_after_market=beforeAfterMarket currency"), ("date", "report_date=reportDate|key date"), ("number", "eps_actual=epsActual eps_estimate=epsEstimate eps_difference=epsDifference surprise_pct=surprisePercent"))),
    "earnings_trend": Spec(("ticker", "date", "period"), _fields(("text", "ticker period"), ("date", "date"), ("number", "growth earnings_estimate_avg=earningsEstimateAvg earnings_estimate_low=earningsEstimateLow earnings_estimate_high=earningsEstimateHigh revenue_estimate_avg=revenueEstimateAvg revenue_estimate_low=revenueEstimateLow revenue_estimate_high=revenueEstimateHigh"))),
    "earnings_calendar": Spec(("ticker", "report_date"), _fields(("text", "ticker=code|ticker before_after_market currency"), ("date", "report_date date"), ("number", "eps_actual=actual eps_estimate=estimate eps_difference=difference surprise_pct=percent"))),
    "fundamentals": Spec(
        ("ticker",),
        _fields(
            ("text", "ticker asset_type=General.Type name=General.Name description=General.Description sector=General.Sector industry=General.Industry gic_sector=General.GicSector gic_industry=General.GicIndustry"),
            ("text", "country=General.CountryName country_iso=General.CountryISO currency=General.CurrencyCode web_url=General.WebURL logo_url=General.LogoURL"),
            ("text", "fiscal_year_end=General.FiscalYearEnd cik=General.CIK isin=General.ISIN primary_ticker=General.PrimaryTicker"),
            ("integer", "full_time_employees=General.FullTimeEmployees"), ("date", "ipo_date=General.IPODate"), ("flag", "is_delisted=General.IsDelisted"),
            ("number", "market_cap=Highlights.MarketCapitalization ebitda=Highlights.EBITDA pe_ratio=Highlights.PERatio peg_ratio=Highlights.PEGRatio eps=Highlights.EarningsShare book_value=Highlights.BookValue"),
            ("number", "dividend_share=Highlights.DividendShare dividend_yield=Highlights.DividendYield profit_margin=Highlights.ProfitMargin operating_margin=Highlights.OperatingMarginTTM"),
            ("number", "return_on_assets=Highlights.ReturnOnAssetsTTM return_on_equity=Highlights.ReturnOnEquityTTM revenue_ttm=Highlights.RevenueTTM gross_profit_ttm=Highlights.GrossProfitTTM"),
            ("number", "quarterly_revenue_growth=Highlights.QuarterlyRevenueGrowthYOY quarterly_earnings_growth=Highlights.QuarterlyEarningsGrowthYOY wall_street_target_price=Highlights.WallStreetTargetPrice"),
            ("block", "general=General highlights=Highlights valuation=Valuation shares_stats=SharesStats technicals=Technicals splits_dividends=SplitsDividends analyst_ratings=AnalystRatings holders=Holders"),
            ("block", "insider_transactions=InsiderTransactions esg_scores=ESGScores outstanding_shares=outstandingShares earnings=Earnings financials=Financials etf_data=ETF_Data components=Components"),
        ),
    ),
    "statements": Spec(("ticker", "date", "period_type"), _fields(("text", "ticker period_type currency=currency_symbol"), ("date", "date filing_date"), ("number", "total_revenue=totalRevenue gross_profit=grossProfit net_income=netIncome total_assets=totalAssets free_cash_flow=freeCashFlow"))),
    "income_statements": Spec(
        ("ticker", "date", "period_type"),
        _fields(
            ("text", "ticker period_type=@none currency=currency_symbol"), ("date", "date=@none filing_date"), ("json", "raw=@"),
            ("number", "total_revenue=totalRevenue cost_of_revenue=costOfRevenue gross_profit=grossProfit research_development=researchDevelopment selling_general_admin=sellingGeneralAdministrative"),
            ("number", "total_operating_expenses=totalOperatingExpenses operating_income=operatingIncome interest_expense=interestExpense income_before_tax=incomeBeforeTax"),
            ("number", "income_tax_expense=incomeTaxExpense net_income=netIncome ebit ebitda"),
        ),
    ),
    "balance_sheets": Spec(
        ("ticker", "date", "period_type"),
        _fields(
            ("text", "ticker period_type=@none currency=currency_symbol"), ("date", "date=@none filing_date"), ("json", "raw=@"),
            ("number", "total_assets=totalAssets total_current_assets=totalCurrentAssets cash short_term_investments=shortTermInvestments net_receivables=netReceivables inventory total_liab=totalLiab"),
            ("number", "total_current_liabilities=totalCurrentLiabilities long_term_debt=longTermDebt short_term_debt=shortTermDebt total_stockholder_equity=totalStockholderEquity"),
            ("number", "retained_earnings=retainedEarnings common_stock=commonStock"),
        ),
    ),
    "cash_flow_statements": Spec(
        ("ticker", "date", "period_type"),
        _fields(
            ("text", "ticker period_type=@none currency=currency_symbol"), ("date", "date=@none filing_date"), ("json", "raw=@"),
            ("number", "operating_cash_flow=totalCashFromOperatingActivities investing_cash_flow=totalCashflowsFromInvestingActivities financing_cash_flow=totalCashFromFinancingActivities"),
            ("number", "capital_expenditures=capitalExpenditures free_cash_flow=freeCashFlow dividends_paid=dividendsPaid stock_repurchase=salePurchaseOfStock change_in_cash=changeInCash"),
        ),
    ),
    "shares_outstanding": Spec(("ticker", "date", "frequency"), _fields(("text", "ticker frequency"), ("date", "date=dateFormatted|date"), ("number", "shares"))),
    "holders": Spec(("ticker", "holder_name", "report_date"), _fields(("text", "ticker holder_name=name"), ("date", "report_date=date"), ("number", "pct_shares=totalShares pct_assets=totalAssets shares_held=currentShares change_shares=change change_pct=change_p"))),
    "insider_transactions": Spec(
        ("ticker", "transaction_date", "owner_name", "transaction_code", "shares"),
        _fields(
            ("text", "ticker=@none owner_cik=ownerCik owner_name=ownerName owner_title=ownerTitle relationship=ownerRelationship transaction_code=transactionCode"),
            ("text", "acquisition_or_disposition=transactionAcquiredDisposed"), ("date", "transaction_date=transactionDate|date report_date=reportDate"), ("number", "shares=transactionAmount price=transactionPrice"),
        ),
        {"value": lambda: F.col("shares") * F.col("price")},
    ),
    "news": Spec(("uuid",), _fields(("text", "uuid=id ticker title content link"), ("timestamp", "published_at=date"), ("texts", "symbols tags"), ("number", "sentiment_polarity=polarity"))),
    "sentiment_daily": Spec(("ticker", "date"), _fields(("text", "ticker"), ("date", "date"), ("integer", "count"), ("number", "normalized"))),
    "ipo_calendar": Spec(("code", "exchange", "start_date"), _fields(("text", "code exchange name currency deal_type"), ("date", "start_date filing_date amended_date"), ("number", "price_from price_to offer_price shares"))),
    "splits_calendar": Spec(("code", "exchange", "split_date"), _fields(("text", "code exchange name"), ("date", "split_date"), ("boolean", "optionable"), ("number", "old_shares new_shares"))),
    "economic_events": Spec(("event_date", "country", "type"), _fields(("timestamp", "event_date=date"), ("text", "country type comparison period"), ("number", "actual previous estimate change change_pct=change_percentage"))),
    "macro_indicators": Spec(("country", "indicator", "date"), _fields(("text", "country=CountryCode|country indicator=Indicator|indicator"), ("date", "date=Date|date"), ("number", "value=Value|value"))),
    "options_chains": Spec(
        ("ticker", "expiration_date", "option_type", "strike", "snapshot_date"),
        _fields(
            ("text", "ticker option_type=type"), ("date", "expiration_date=expirationDate snapshot_date"), ("timestamp", "last_trade_date=lastTradeDateTime"),
            ("number", "strike last=lastPrice change change_pct=changePercent bid ask implied_volatility=impliedVolatility delta gamma theta vega rho theoretical intrinsic_value=intrinsicValue time_value=timeValue"),
            ("integer", "volume open_interest=openInterest"), ("flag", "in_the_money=inTheMoney"),
        ),
    ),
}


def typed(payloads: DataFrame, spec: Spec, payload: str, order: Column, *beside: str) -> DataFrame:
    """The fields of every payload, one row each, with order as _order and the input's columns named in beside."""
    fields = F.from_json(payload, "map<string,string>")
    rows = payloads.withColumn("_f", fields)

    def found_at(spelling: str) -> Column:
        if spelling == "@":
            return F.col(payload)
        section, _, inner = spelling.partition(".")
        return F.get_json_object(F.col("_f")[section], f"$.{inner}") if inner else F.col("_f")[section]

    def value(name: str, kind: str, spellings: tuple[str, ...]) -> Column:
        found = [F.nullif(found_at(s), F.lit("")) for s in spellings]
        given = [F.col(name).cast("string")] if name in payloads.columns else []
        return KINDS[kind](F.coalesce(*found, *given)).alias(name)

    made = rows.select(*[value(n, *c) for n, c in spec.columns.items()], order.alias("_order"), *beside)
    for name, derived in spec.derived.items():
        made = made.withColumn(name, derived())
    return made


def has_keys(spec: Spec) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in spec.keys])


def last_of_each(rows: DataFrame, spec: Spec) -> DataFrame:
    """Of typed rows with all keys, the one of the greatest _order of each key."""
    keyed = rows.where(has_keys(spec))
    rest = [c for c in keyed.columns if c not in spec.keys and c != "_order"]
    best = F.max_by(F.struct(*rest), "_order").alias("_row")
    return keyed.groupBy(*spec.keys).agg(best).select(*spec.keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def ingest(payloads: DataFrame, spec: Spec, payload: str = "payload", order: str | None = None) -> DataFrame:
    """Typed rows of `payload`, a JSON object a row. Columns of the input named like a field fill it where the payload has none.

    order is a column that tells the last payload of a key. Without it payloads are taken in the order of the input's rows, which
    Spark keeps for files and local rows that were not shuffled.
    """
    return last_of_each(typed(payloads, spec, payload, F.col(order) if order else F.monotonically_increasing_id()), spec)


def explode_dated(payloads: DataFrame, payload: str, *sections: str) -> DataFrame:
    """Payloads {section: {date: row}} as a row (section, key, row JSON) each, beside the input's other columns."""
    beside = [c for c in payloads.columns if c != payload]
    opened = payloads.select(*beside, F.explode(F.from_json(payload, "map<string,map<string,string>>")).alias("section", "rows"))
    opened = opened.where(F.col("section").isin(*sections)) if sections else opened
    return opened.select(*beside, "section", F.explode("rows").alias("key", payload))


def _values(text: Column) -> Column:
    """The values of a JSON object, or the items of an array, as JSON texts."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith("{"), F.map_values(F.from_json(text, "map<string,string>")))


def _section(payloads: DataFrame, payload: str, path: str) -> DataFrame:
    beside = [c for c in payloads.columns if c != payload]
    return payloads.select(*beside, F.get_json_object(payload, path).alias(payload))


def open_trend(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Estimates as a row each: under Quarterly and Annual, as objects or lists, or, where both are missing, flat."""
    trend = _section(payloads, payload, "$.Earnings.Trend")
    beside = [c for c in payloads.columns if c != payload]
    none = F.array().cast("array<string>")
    nested = F.concat(*[F.coalesce(_values(F.get_json_object(payload, f"$.{k}")), none) for k in ("Quarterly", "Annual")])
    return trend.select(*beside, F.explode(F.when(F.size(nested) > 0, nested).otherwise(_values(F.col(payload)))).alias(payload))


def fan_out(payloads: DataFrame, payload: str = "payload") -> dict[str, DataFrame]:
    """All tables that a ticker's fundamentals payload feeds. The input has the columns ticker and payload."""
    beside = [c for c in payloads.columns if c != payload]

    def listed(path: str) -> DataFrame:
        return _section(payloads, payload, path).select(*beside, F.explode(_values(F.col(payload))).alias(payload))

    def dated(path: str, *sections: str) -> DataFrame:
        return explode_dated(_section(payloads, payload, path), payload, *sections)

    statements = {"income_statements": "Income_Statement", "balance_sheets": "Balance_Sheet", "cash_flow_statements": "Cash_Flow"}
    found = {"fundamentals": ingest(payloads, SPECS["fundamentals"], payload)}
    for name, block in statements.items():
        rows = dated(f"$.Financials.{block}", "yearly", "quarterly").withColumnsRenamed({"section": "period_type", "key": "date"})
        found[name] = ingest(rows, SPECS[name], payload)
    history = explode_dated(_section(payloads, payload, "$.Earnings"), payload, "History").withColumnRenamed("key", "report_date")
    found["earnings_history"] = ingest(history, SPECS["earnings_history"], payload)
    found["earnings_trend"] = ingest(open_trend(payloads, payload), SPECS["earnings_trend"], payload)
    shares = dated("$.outstandingShares", "annual", "quarterly").withColumnRenamed("section", "frequency")
    found["shares_outstanding"] = ingest(shares, SPECS["shares_outstanding"], payload)
    for name, block in {"institutional_holders": "Institutions", "fund_holders": "Funds"}.items():
        found[name] = ingest(listed(f"$.Holders.{block}"), SPECS["holders"], payload)
    return found


def ingest_insider(old: DataFrame, payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """old with the new transactions, and with what these know of old ones of the same day, owner, code and price to four digits."""
    new = ingest(payloads, SPECS["insider_transactions"], payload)
    both = insert_ignore(old, new, list(SPECS["insider_transactions"].keys))
    digits = F.round(F.col("price").cast("decimal(38,10)"), 4)
    fill = ["report_date", "owner_title", "relationship", "acquisition_or_disposition", "shares", "price", "value"]
    keys = ["ticker", "transaction_date", "owner_name", "transaction_code", "_price"]
    given = new.withColumn("_price", digits).where("transaction_code is not null")
    return enrich(both.withColumn("_price", digits), given, keys, fill, zero=["shares"]).drop("_price")


def upsert_roster(old: DataFrame, payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Symbols with a new roster: all but the day of delisting is the new one's, which keeps an old day that it does not know."""
    new = ingest(payloads, SPECS["roster"], payload).select(*old.columns)
    days = coalescing_upsert(old, new, ["ticker"]).select("ticker", F.col("delisted_on").alias("_on"))
    return upsert(old, new, ["ticker"]).join(days, "ticker").withColumn("delisted_on", F.col("_on")).select(*old.columns)


def run_all(steps: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], list[tuple[str, str, str | None]]]:
    """Runs every step, those after one that fails too. What they gave, and (step, ok or failed, error) of each."""
    made, log = {}, []
    for name, step in steps.items():
        try:
            made[name] = step()
            log.append((name, "ok", None))
        except Exception as e:  # noqa: BLE001  the log tells which and why
            log.append((name, "failed", f"{type(e).__name__}: {e}"))
    return made, log


def explode_options(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads {data: [{expirationDate, options: {CALL: [contract], PUT: [contract]}}]} as a row a contract, beside the input's other columns.

    The input brings snapshot_date, the day the chain was seen.
    """
    beside = [c for c in payloads.columns if c != payload]
    chains = F.from_json(payload, "struct<data:array<struct<expirationDate:string,options:map<string,array<string>>>>>")
    opened = payloads.select(*beside, F.explode(chains["data"]).alias("_c")).where(to_date(F.col("_c.expirationDate")).isNotNull())
    sides = opened.select(*beside, F.col("_c.expirationDate").alias("expiration_date"), F.explode("_c.options").alias("option_type", "_contracts")).where(F.col("option_type").isin("CALL", "PUT"))
    return sides.select(*beside, "expiration_date", "option_type", F.explode("_contracts").alias(payload))


def split_ratio(text: Column) -> tuple[Column, Column]:
    """'a/b' as two numbers."""
    return to_number(F.split_part(text, F.lit("/"), F.lit(1))), to_number(F.split_part(text, F.lit("/"), F.lit(2)))


def qualified(code: Column, exchange: Column) -> Column:
    return F.concat_ws(".", F.upper(F.trim(code)), F.upper(F.trim(exchange)))


def ticker_parts(ticker: Column) -> tuple[Column, Column]:
    """Code and exchange, split at the last dot; both null without one."""
    has = ticker.contains(".")
    return F.when(has, F.regexp_extract(ticker, r"^(.*)\.[^.]*$", 1)), F.when(has, F.regexp_extract(ticker, r"\.([^.]*)$", 1))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities to null, as JSON and CSV sinks want them."""
    return df.select(*[F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])
