"""SQL of the derived tables and of the queries over them, for an engine other than Spark.

oracle(sql) puts the definitions that sql needs in front of it. Rounding is by plain arithmetic,
sums are of decimals, and every order is total, so results can be compared value by value.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2001-06-30'"
EVENTS_AS_OF = "DATE '2024-01-30'"


def R(e: str, n: int = 4) -> str:
    return f"(floor(({e}) * 1e{n} + 0.5) / 1e{n})"


def PCT(now: str, before: str, n: int = 2) -> str:
    return f"(CASE WHEN {before} > 0 THEN {R(f'({now} / {before} - 1) * 100.0', n)} END)"


def _quarter_end(d: str) -> str:
    return f"last_day(CAST(date_trunc('quarter', {d}) AS DATE) + INTERVAL 2 MONTH)"


def _prices(key: str) -> str:
    close = R("CAST(sum(x) AS DOUBLE) / CAST(sum(q) AS DOUBLE)")
    return f"""SELECT CAST({key} AS VARCHAR) AS ticker, date, {close} AS close, {close} AS adjusted_close, {R('max(unit)')} AS high, {R('min(unit)')} AS low,
        CAST(sum(q) * 10000 AS BIGINT) AS volume FROM lines GROUP BY {key}, date"""


def _holdings(holder: str, period: str, cut: int) -> str:
    return f"""SELECT h.ticker, h.holder_name, report_date, report_date + 5 AS observed_at, shares_held,
        {R('shares_held / all_shares * 100')} AS pct_shares, {R('shares_held / whole_book * 100')} AS pct_assets,
        CASE WHEN length(h.holder_name) % {cut} = {cut - 1} THEN NULL ELSE last_change END AS change_shares,
        CASE WHEN shares_held - last_change = 0 THEN 0.0 ELSE {R('last_change / (shares_held - last_change) * 100')} END AS change_pct
      FROM (SELECT *, sum(shares_held) OVER (PARTITION BY ticker) AS all_shares, sum(shares_held) OVER (PARTITION BY holder_name) AS whole_book FROM (
        SELECT ticker, holder_name, max(report_date) AS report_date, sum(c) AS shares_held, arg_max(c, report_date) AS last_change FROM (
          SELECT ticker, {holder} AS holder_name, {period} AS report_date,
                 CAST(sum(CASE WHEN l_returnflag = 'R' THEN -q ELSE q END * 1000) AS DOUBLE) AS c
          FROM lines JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)
        GROUP BY 1, 2 HAVING sum(c) > 0)) h"""


def _statements(key: str) -> str:
    return f"""SELECT ticker, date, CASE WHEN n % 4 = 0 THEN NULL ELSE date + 45 END AS filing_date, {R('revenue', 2)} AS total_revenue,
        {R('revenue - coalesce(ret, 0)', 2)} AS gross_profit, {R('coalesce(acc, 0) - coalesce(ret, 0)', 2)} AS net_income, {R('e', 2)} AS ebitda,
        {R('units * 1000', 2)} AS total_assets, {R('units * 400', 2)} AS total_current_assets, n * 5000.0::DOUBLE AS total_current_liabilities,
        n * 9000.0::DOUBLE AS long_term_debt, {R('units * 600', 2)} AS total_stockholder_equity, n * 700.0::DOUBLE AS cash,
        {R('revenue * 0.1::DOUBLE - coalesce(ret, 0) * 0.05::DOUBLE', 2)} AS free_cash_flow, {R('revenue * 0.15::DOUBLE - coalesce(ret, 0) * 0.05::DOUBLE', 2)} AS operating_cash_flow, units * 100 AS shares
      FROM (SELECT CAST({key} AS VARCHAR) AS ticker, make_date(year(date), 12, 31) AS date, CAST(sum(x * (1 - disc)) AS DOUBLE) AS revenue, CAST(sum(x * tax) AS DOUBLE) AS e,
            CAST(sum(x) FILTER (l_returnflag = 'R') AS DOUBLE) AS ret, CAST(sum(x) FILTER (l_returnflag = 'A') AS DOUBLE) AS acc, CAST(sum(q) AS DOUBLE) AS units, count(*) AS n
          FROM lines GROUP BY 1, 2) WHERE date <= {AS_OF}"""


_NUM = "CAST(substr(p_brand, 7) AS INTEGER)"
_FLOORS = "close >= 5.0 AND avg_vol_20d >= 100000.0"

#: Derived tables in order of definition.
DEFINED: dict[str, str] = {
    "lines": f"""SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DECIMAL(18,2)) AS q,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS x, CAST(l_discount AS DECIMAL(18,2)) AS disc, CAST(l_tax AS DECIMAL(18,2)) AS tax, l_extendedprice / l_quantity AS unit
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CAST(l_shipdate AS DATE) <= {AS_OF}""",
    "eod_prices": _prices("ticker"),
    "eod_prices_x": _prices("l_suppkey"),
    "fundamentals": f"""SELECT p_brand AS ticker, min(p_name) AS name, 'Sector ' || (n % 5) AS sector, 'Industry ' || (n % 7) AS industry,
        CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) * 10000 AS market_cap, CASE WHEN n % 6 = 0 THEN NULL ELSE 8.0::DOUBLE + (n * 7) % 23 END AS pe_ratio,
        0.5::DOUBLE + (n % 4) * 0.5::DOUBLE AS peg_ratio, (n % 9) / 20.0::DOUBLE AS profit_margin, (n % 8) / 25.0::DOUBLE AS return_on_equity, (n % 5) / 50.0::DOUBLE AS dividend_yield,
        (n % 11) / 30.0::DOUBLE AS quarterly_revenue_growth, (n % 13) / 40.0::DOUBLE AS quarterly_earnings_growth, n % 12 = 11 AS is_delisted,
        CASE WHEN n % 10 = 0 THEN 'ETF' WHEN n % 7 = 0 THEN NULL ELSE 'Common Stock' END AS type, CASE WHEN n % 3 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange,
        CASE WHEN n % 8 = 5 THEN DATE '2000-06-30' END AS delisted_on
      FROM (SELECT *, {_NUM} AS n FROM part) GROUP BY p_brand, n""",
    "institutional_holders": _holdings("s_name", _quarter_end("date"), 97),
    "fund_holders": _holdings("n_name", "last_day(date)", 5),
    "statements": _statements("ticker"),
    "statements_x": _statements("l_suppkey"),
    "earnings_history": f"""SELECT ticker, date + 30 AS report_date, date, eps_actual, eps_estimate, CASE WHEN eps_estimate > 0 THEN {R('(eps_actual / eps_estimate - 1) * 100')} END AS surprise_pct
      FROM (SELECT *, {R('avg(eps_actual) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)')} AS eps_estimate
        FROM (SELECT ticker, {_quarter_end('date')} AS date, {R('CAST(sum(x * (1 - disc)) AS DOUBLE) / CAST(sum(q) AS DOUBLE) / 100')} AS eps_actual FROM lines GROUP BY 1, 2) WHERE date <= {AS_OF})""",
    "analyst_ratings": f"""SELECT ticker, date, CASE WHEN n % 9 = 0 THEN NULL ELSE 1.0::DOUBLE + (u % 401) / 100.0::DOUBLE END AS rating, {R('top * 0.9::DOUBLE')} AS target_price,
        CAST(u % 7 AS INTEGER) AS strong_buy, CAST(u % 5 AS INTEGER) AS buy, CAST(u % 3 AS INTEGER) AS hold, CAST(u % 4 AS INTEGER) AS sell, CAST(u % 2 AS INTEGER) AS strong_sell
      FROM (SELECT ticker, {_quarter_end('date')} AS date, CAST(sum(q) AS BIGINT) AS u, max(unit) AS top, count(*) AS n FROM lines GROUP BY 1, 2) WHERE date <= {AS_OF}""",
    "dividends": f"""SELECT ticker, ex_date, {R('v / 10')} AS value FROM (SELECT ticker, {_quarter_end('date')} AS ex_date, CAST(sum(q) AS DOUBLE) / count(*) AS v
      FROM lines WHERE l_returnflag = 'A' GROUP BY 1, 2) WHERE ex_date <= {AS_OF}""",
    "insider_transactions": f"""SELECT event_id, 'Brand#' || (1 + user_id % 25) AS ticker, CAST(ts AS DATE) AS transaction_date, 'U' || user_id AS owner_name,
        CASE WHEN user_id % 2 = 0 THEN 'Director' ELSE 'Officer' END AS relationship, CASE event_type WHEN 'purchase' THEN 'P' WHEN 'error' THEN 'S' ELSE 'A' END AS transaction_code,
        CAST(10 + event_id % 90 AS DOUBLE) AS shares, value AS price, {R('(10 + event_id % 90) * value', 2)} AS value,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) + CAST(event_id % 5 AS INTEGER) END AS report_date FROM events""",
    "sentiment_daily": f"""SELECT 'Brand#' || (1 + user_id % 25) AS ticker, CAST(ts AS DATE) AS date, count(*) AS count,
        {R('CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 100')} AS normalized FROM events GROUP BY 1, 2""",
    "news": """SELECT event_id, 'story ' || (event_id % 4000) AS title, 'Brand#' || (1 + user_id % 25) AS ticker, ['Brand#' || (1 + user_id % 25), 'Brand#' || (1 + (user_id + 3) % 25)] AS symbols,
        ts AS published_at, (event_id % 41) / 20.0::DOUBLE - 1.0 AS sentiment_polarity, props FROM events""",
    "trades": f"""SELECT o_custkey % 10 AS portfolio_id, ticker, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, date AS trade_date, q AS quantity,
        CAST({R('unit')} AS DECIMAL(18,4)) AS price, CAST(tax * x AS DECIMAL(18,4)) AS fees FROM lines JOIN orders ON l_orderkey = o_orderkey""",
    "portfolios": "SELECT id AS portfolio_id, 'book ' || id AS name, id * 1000.0::DOUBLE AS initial_cash FROM (SELECT DISTINCT CAST(c_custkey % 12 AS BIGINT) AS id FROM customer)",
    "growth_statements": f"""SELECT ticker, date, {R('sales', 2)} AS total_revenue, {R('pretax', 2)} AS income_before_tax, {R('pretax * 0.7::DOUBLE', 2)} AS net_income,
        n * 3000.0::DOUBLE * (b % 4) AS long_term_debt, n * 500.0::DOUBLE AS short_term_debt, units * 600 AS total_stockholder_equity
      FROM (SELECT *, sales * (b % 6 - 1) / 20.0::DOUBLE AS pretax FROM (SELECT *, revenue * pow(1 + (b * 3) % 8 * 0.04::DOUBLE, year(date) - 1990) AS sales FROM (
        SELECT ticker, CAST(substr(ticker, 7) AS INTEGER) AS b, make_date(year(date), 12, 31) AS date, CAST(sum(x * (1 - disc)) AS DOUBLE) AS revenue, CAST(sum(q) AS DOUBLE) AS units, count(*) AS n
        FROM lines GROUP BY ALL))) WHERE date <= {AS_OF}""",
    "growth_earnings": f"""SELECT ticker, date, CASE WHEN NOT (b % 9 = 4 AND month(date) = 3) THEN {R('eps_actual * pow(1 + (b * 5) % 7 * 0.04::DOUBLE, year(date) - 1998)')} END AS eps_actual
      FROM (SELECT *, CAST(substr(ticker, 7) AS INTEGER) AS b FROM earnings_history)""",
    "earnings_trend": f"""SELECT ticker, date, period, {R(f"CASE WHEN date = {AS_OF} AND n % 5 = 0 THEN NULL WHEN date = {AS_OF} THEN growth ELSE growth + 0.001::DOUBLE END")} AS growth FROM (
        SELECT ticker, n, p.period, p.shift::DOUBLE + (n * 5) % 7 * 0.04::DOUBLE AS growth FROM (SELECT ticker, CAST(substr(ticker, 7) AS INTEGER) AS n FROM fundamentals),
          (VALUES ('+5y', 0.02, 0), ('+1y', -0.05, 1), ('0y', 0.3, 2)) p(period, shift, most) WHERE n % 3 <= most), (VALUES (DATE '2001-03-31'), ({AS_OF})) d(date)""",
    "latest_price": "SELECT ticker, max(date) AS price_date, arg_max(close, date) AS price FROM eod_prices GROUP BY ticker",
}


def _flow(source: str, more: str) -> str:
    first = "change_shares = shares_held AND change_shares <> 0"
    return f"""SELECT ticker, holder_name, report_date, observed_at, shares_held, pct_shares, {more} change_shares, change_pct, shares_held - change_shares AS prior_shares,
        CASE WHEN {first} THEN 'initiated' WHEN change_shares = 0 THEN 'unchanged' WHEN change_shares > 0 THEN 'added' WHEN change_shares < 0 THEN 'trimmed' END AS action,
        CASE WHEN NOT ({first}) THEN change_pct END AS change_pct_clean FROM {source} WHERE change_shares IS NOT NULL"""


def _count(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


_NOW = "report_date = latest_filing"
_IN = "report_date >= latest_filing - 95"
DEFINED |= {
    "inst_flow": _flow("institutional_holders", "pct_assets,"),
    "fund_flow": _flow("fund_holders", ""),
    "inst_flow_ticker": f"""SELECT ticker, latest_filing, min(report_date) AS earliest_filing, max(observed_at) AS observed_at, count(*) AS top_n_holders, count(*) >= 20 AS top_n_at_cap,
        {_count(_NOW)} AS holders_at_latest, {_count('report_date <> latest_filing')} AS holders_lagging, sum(shares_held) AS top_n_shares,
        {R('CAST(sum(CAST(pct_shares AS DECIMAL(18,4))) AS DOUBLE)')} AS top_n_pct_of_shares_out, {R('max(pct_shares)')} AS largest_holder_pct, {R('max(pct_assets)')} AS max_holder_conviction_pct,
        sum(change_shares) FILTER ({_NOW}) AS net_change_shares, sum(prior_shares) FILTER ({_NOW}) AS prior_shares_at_latest,
        CASE WHEN sum(prior_shares) FILTER ({_NOW}) > 0 THEN {R(f'sum(change_shares) FILTER ({_NOW}) / sum(prior_shares) FILTER ({_NOW}) * 100.0', 2)} END AS net_change_pct,
        {", ".join(f"{_count(f'''action = '{a}' AND {_NOW}''')} AS n_{a}" for a in ("added", "trimmed", "initiated", "unchanged"))}
      FROM (SELECT *, max(report_date) OVER (PARTITION BY ticker) AS latest_filing FROM inst_flow) GROUP BY ticker, latest_filing""",
    "fund_flow_ticker": f"""SELECT ticker, latest_filing, min(report_date) FILTER ({_IN}) AS window_earliest_filing, latest_filing - min(report_date) FILTER ({_IN}) AS filing_span_days,
        max(observed_at) AS observed_at, count(*) AS top_n_funds, {_count(_IN)} AS funds_in_window, {_count('report_date < latest_filing - 95')} AS funds_stale, sum(shares_held) AS top_n_shares,
        {R('CAST(sum(CAST(pct_shares AS DECIMAL(18,4))) AS DOUBLE)')} AS top_n_pct_of_shares_out, sum(change_shares) FILTER ({_IN}) AS net_change_shares, sum(prior_shares) FILTER ({_IN}) AS prior_shares_in_window,
        CASE WHEN sum(prior_shares) FILTER ({_IN}) > 0 THEN {R(f'sum(change_shares) FILTER ({_IN}) / sum(prior_shares) FILTER ({_IN}) * 100.0', 2)} END AS net_change_pct,
        {", ".join(f"{_count(f'''action = '{a}' AND {_IN}''')} AS n_{a}" for a in ("initiated", "added", "trimmed"))}
      FROM (SELECT *, max(report_date) OVER (PARTITION BY ticker) AS latest_filing FROM fund_flow) GROUP BY ticker, latest_filing""",
    "price_perf": f"""SELECT ticker, date AS as_of, adjusted_close AS close, volume, floor(avg_vol + 0.5) AS avg_vol_20d, CASE WHEN avg_vol > 0 THEN {R('volume / avg_vol', 2)} END AS vol_ratio,
        {", ".join(f"{PCT('adjusted_close', f'c_{n}')} AS ret_{n}" for n in ("1d", "5d", "1m", "3m", "12m"))}
      FROM (SELECT *, {", ".join(f"lag(adjusted_close, {k}) OVER w AS c_{n}" for n, k in (("1d", 1), ("5d", 5), ("1m", 21), ("3m", 63), ("12m", 252)))},
          avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS avg_vol, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn
        FROM eod_prices WHERE ticker IN (SELECT ticker FROM institutional_holders) AND date >= {AS_OF} - 400 AND adjusted_close > 0
        WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE rn = 1""",
}


def oracle(sql: str) -> str:
    """sql with the definitions it needs, of their own needs too, in front."""
    needed: set[str] = set()

    def look(text: str) -> None:
        for name in DEFINED:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                look(DEFINED[name])

    look(sql)
    ctes = ",\n".join(f"{name} AS ({DEFINED[name]})" for name in DEFINED if name in needed)
    joined = re.sub(r"^\s*WITH\s+", "", sql) if (has := re.match(r"\s*WITH\s", sql)) else sql
    return f"WITH {ctes},\n{joined}" if has and ctes else f"WITH {ctes}\n{sql}" if ctes else sql
