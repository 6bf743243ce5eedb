"""SQL of signals, portfolios, overlays and the parts of the stock study that SQL can express."""

from __future__ import annotations

from .oracle import AS_OF, DEFINED, EVENTS_AS_OF, R

DEFINED |= {
    "listed": "SELECT ticker, market_cap FROM fundamentals WHERE NOT is_delisted AND (type IS NULL OR lower(type) = 'common stock')",
    "positions_open": f"""SELECT portfolio_id, ticker, CAST(sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS DOUBLE) AS quantity,
        coalesce({R("CAST(sum(CASE WHEN side = 'BUY' THEN quantity * price ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) AS DOUBLE), 0)")}, 0.0) AS avg_buy_price,
        CAST(sum(CASE WHEN side = 'BUY' THEN quantity * price ELSE -(quantity * price) END + fees) AS DOUBLE) AS cost_basis, min(trade_date) AS first_trade_date, max(trade_date) AS last_trade_date, count(*) AS trade_count
      FROM trades GROUP BY 1, 2 HAVING sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) <> 0""",
    "annual_eps": "SELECT ticker, year(date) AS year, CAST(sum(CAST(eps_actual AS DECIMAL(18,4))) AS DOUBLE) AS eps, count(*) AS quarters FROM earnings_history WHERE eps_actual IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3",
    "sig_value": f"""SELECT ticker, CASE WHEN reason IS NULL THEN {R('ttm / px', 8)} END AS value, reason, ttm < 0 AS negative_earnings, latest_earnings_date FROM (
        SELECT l.ticker, ttm, px, d AS latest_earnings_date, CASE WHEN coalesce(n, 0) < 4 THEN 'insufficient_eps_history' WHEN px IS NULL THEN 'no_price' END AS reason FROM listed l
        LEFT JOIN (SELECT ticker, CAST(sum(CAST(eps_actual AS DECIMAL(18,4))) AS DOUBLE) AS ttm, count(*) AS n, max(date) AS d FROM (SELECT * FROM earnings_history WHERE report_date <= {AS_OF} AND eps_actual IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 4) GROUP BY ticker) e ON e.ticker = l.ticker
        LEFT JOIN (SELECT ticker, arg_max(adjusted_close, date) AS px FROM eod_prices WHERE adjusted_close > 0 GROUP BY ticker) p ON p.ticker = l.ticker)""",
}


def _leg(name: str, target: str) -> str:
    return f"(SELECT ticker, arg_max(adjusted_close, date) AS p_{name}, max(date) AS d_{name} FROM eod_prices WHERE date <= {target} AND date >= DATE '2000-06-28' - 15 GROUP BY ticker)"


def _sma(n: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return R(f"CASE WHEN count(close) {w} = {n} THEN CAST(sum(CAST(close AS DECIMAL(18,4))) {w} AS DOUBLE) / {n} END") + f" AS sma_{n}"


_W20 = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_S, _SS = f"CAST(sum(CAST(close AS DECIMAL(12,4))) {_W20} AS DOUBLE)", f"CAST(sum(CAST(CAST(close AS DECIMAL(18,4)) * CAST(close AS DECIMAL(19,4)) AS DECIMAL(24,8))) {_W20} AS DOUBLE)"
SQL = {
    "universe_select": "SELECT * FROM listed",
    "sig_value": "SELECT * FROM sig_value",
    "select_rank": """SELECT ticker, value, CAST(row_number() OVER (ORDER BY value DESC, ticker) AS INTEGER) AS rank, (SELECT count(*) FROM sig_value) AS universe, (SELECT count(value) FROM sig_value) AS rankable,
        (SELECT count(*) - count(value) FROM sig_value) AS excluded FROM sig_value WHERE value IS NOT NULL""",
    "sig_momentum": f"""SELECT ticker, CASE WHEN reason IS NULL THEN {R('p_recent / p_old - 1.0', 6)} END AS value, reason, d_recent AS recent_price_date, d_old AS old_price_date FROM (
        SELECT l.ticker, p_recent, p_old, d_recent, d_old, CASE WHEN p_recent IS NULL OR p_old IS NULL THEN 'insufficient_price_history' WHEN DATE '2001-05-28' - d_recent > 10 OR DATE '2000-06-28' - d_old > 10 THEN 'stale_price_window' END AS reason
        FROM listed l LEFT JOIN {_leg('recent', "DATE '2001-05-28'")} a ON a.ticker = l.ticker LEFT JOIN {_leg('old', "DATE '2000-06-28'")} b ON b.ticker = l.ticker)""",
    "sig_insider": f"""WITH a AS (SELECT ticker, count(*) AS n, count(DISTINCT owner_name) AS n_insiders, CAST(sum(CASE WHEN transaction_code = 'P' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS b, CAST(sum(CASE WHEN transaction_code = 'S' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS s
        FROM insider_transactions WHERE transaction_code IN ('P', 'S') AND value IS NOT NULL AND transaction_date > {EVENTS_AS_OF} - 30 AND transaction_date <= {EVENTS_AS_OF} AND coalesce(report_date, transaction_date + 4) <= {EVENTS_AS_OF} GROUP BY ticker),
      r AS (SELECT l.ticker, coalesce(n, 0) AS n_txns, n_insiders, {R('b - s', 2)} AS net, CASE WHEN coalesce(n, 0) = 0 THEN 'no_activity' WHEN n < 2 THEN 'below_min_txns' END AS reason FROM listed l LEFT JOIN a ON a.ticker = l.ticker)
      SELECT ticker, CASE WHEN reason IS NULL THEN net END AS value, reason, n_txns, n_insiders, CASE WHEN net > 0 THEN 'net_buying' WHEN net < 0 THEN 'net_selling' WHEN net = 0 THEN 'net_flat' END AS direction, net < 0 AS sales_are_noisier FROM r""",
    "booked_trades": """SELECT portfolio_id, side, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS quantity FROM trades WHERE day(trade_date) > 2 AND portfolio_id <> 3 GROUP BY 1, 2""",
    "renamed_portfolios": "SELECT portfolio_id, CASE WHEN portfolio_id = 1 THEN 'first' ELSE name END AS name, CASE WHEN portfolio_id = 2 THEN 5.0 ELSE initial_cash END AS initial_cash FROM portfolios",
    "portfolio_positions": "SELECT * FROM positions_open",
    "portfolio_summary": """SELECT p.*, count(t.ticker) AS trade_count, count(DISTINCT t.ticker) AS ticker_count, coalesce(CAST(sum(CASE WHEN side = 'BUY' THEN quantity * price + fees ELSE 0 END) AS DOUBLE), 0) AS gross_invested,
        coalesce(CAST(sum(CASE WHEN side = 'SELL' THEN quantity * price - fees ELSE 0 END) AS DOUBLE), 0) AS gross_proceeds FROM portfolios p LEFT JOIN trades t ON t.portfolio_id = p.portfolio_id GROUP BY p.portfolio_id, name, initial_cash""",
    "positions": f"""SELECT *, {R('unrealised / nullif(cost_basis, 0) * 100', 2)} AS unrealised_pct FROM (SELECT *, {R('market_value - cost_basis', 2)} AS unrealised FROM (SELECT o.*, price_date, price, name, {R('quantity * price', 2)} AS market_value FROM positions_open o
      LEFT JOIN latest_price p ON p.ticker = o.ticker LEFT JOIN fundamentals f ON f.ticker = o.ticker))""",
    "portfolio_value_history": """WITH d AS (SELECT portfolio_id, ticker, trade_date, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS q FROM trades GROUP BY ALL),
      h AS (SELECT *, sum(q) OVER (PARTITION BY portfolio_id, ticker ORDER BY trade_date) AS held FROM d), k AS (SELECT DISTINCT portfolio_id, ticker FROM d)
      SELECT v.portfolio_id, v.date, CAST(sum(CAST(CAST(held AS DECIMAL(18,2)) * CAST(v.adjusted_close AS DECIMAL(18,4)) AS DECIMAL(30,6))) AS DOUBLE) AS market_value
      FROM (SELECT k.portfolio_id, e.* FROM eod_prices e JOIN k ON k.ticker = e.ticker) v ASOF JOIN h ON h.portfolio_id = v.portfolio_id AND h.ticker = v.ticker AND h.trade_date <= v.date GROUP BY 1, 2""",
    "trades_with_symbol": "SELECT portfolio_id, t.ticker, side, trade_date, CAST(quantity AS DOUBLE) AS quantity, CAST(price AS DOUBLE) AS price, CAST(fees AS DOUBLE) AS fees, name, exchange FROM trades t LEFT JOIN fundamentals f ON f.ticker = t.ticker",
    "sma_overlays": f"SELECT ticker, date, close, {_sma(20)}, {_sma(50)}, {_sma(200)}, {R('close - lag(close) OVER (PARTITION BY ticker ORDER BY date)')} AS change FROM eod_prices",
    "bollinger": f"""SELECT ticker, date, {R('m', 3)} AS middle, {R('m + 2.0::DOUBLE * d', 3)} AS upper, {R('m - 2.0::DOUBLE * d', 3)} AS lower FROM (SELECT ticker, date, CASE WHEN n = 20 THEN s / 20 END AS m, CASE WHEN n = 20 THEN sqrt(greatest(0.0, (ss - s * s / 20) / 19)) END AS d
      FROM (SELECT ticker, date, count(close) {_W20} AS n, {_S} AS s, {_SS} AS ss FROM eod_prices))""",
    "symbol_search": "SELECT ticker, name, exchange FROM fundamentals WHERE ticker ILIKE '%brand#2%' OR name ILIKE '%brand#2%' ORDER BY lower(ticker) = 'brand#2' DESC, starts_with(lower(ticker), 'brand#2') DESC, length(ticker), ticker LIMIT 20",
    "news_for_symbol": "SELECT event_id, title, ticker, published_at, sentiment_polarity FROM news WHERE list_contains(symbols, 'Brand#7') ORDER BY published_at DESC, event_id DESC LIMIT 50",
    "news_props": "SELECT 'k' AS key, props->>'k' AS value, count(*) AS n FROM news GROUP BY 2",
    "annual_eps": "SELECT * FROM annual_eps",
    "price_extremes": "SELECT ticker, year(date) AS year, min(low) AS low, max(high) AS high FROM eod_prices GROUP BY 1, 2",
    "loglinear_growth": f"SELECT ticker, count(*) AS points, {R('exp(regr_slope(ln(eps), CAST(year AS DOUBLE))) - 1', 5)} AS growth FROM annual_eps WHERE eps > 0 GROUP BY ticker HAVING count(*) >= 2",
    "year_end_close": "SELECT ticker, year(date) AS year, arg_max(close, date) AS close FROM eod_prices GROUP BY 1, 2",
}
