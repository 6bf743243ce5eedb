"""SQL of the backtests: tables keyed by date and ticker, like the plans."""

from __future__ import annotations

from .backtest import BALANCE, CASH_FLOW, DELISTED, END, HOLDOUT, INCOME, START, _RATIOS
from .oracle import DEFINED, R


def _at(back: int, name: str) -> str:
    return f"""SELECT p.as_of, p.ticker, e.adjusted_close AS {name} FROM (SELECT *, as_of - {back} AS at FROM probes) p ASOF JOIN eod_prices_x e ON e.ticker = p.ticker AND e.date <= p.at WHERE e.date >= p.at - 30"""


def _z(*columns: str) -> str:
    return " + ".join(f"(CASE WHEN stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END)" for c in columns)


def _statement(rank: int) -> str:
    return f"""SELECT p.as_of, s.* EXCLUDE (filing_date) FROM probes p JOIN statements_x s ON s.ticker = p.ticker WHERE coalesce(filing_date, date + 45) <= as_of
      QUALIFY row_number() OVER (PARTITION BY as_of, p.ticker ORDER BY date DESC) = {rank}"""


def _parts(side: str) -> str:
    return ", ".join(f"{R(f'{a} / nullif({b}, 0)', 8)} AS {n}_{side}" for n, (a, b) in _RATIOS.items())


_NAMES = {"momentum": "bt_momentum", "quality": "bt_quality", "value": "bt_value", "piotroski": "bt_piotroski", "value_piotroski": "bt_value_piotroski"}
_PLACE = "row_number() OVER (PARTITION BY as_of ORDER BY value, ticker)"
_N = "count(*) OVER (PARTITION BY as_of)"
_BIN = f"CAST(greatest(0, floor((({_PLACE} - 1) * 10 + {_N} - 2) / greatest({_N} - 1, 1)) - 1) AS INTEGER)"


def _avg_rank(c: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0)"


def _section(signal: str) -> str:
    return f"""SELECT r.as_of, ticker, value, greatest(lo, least(hi, fwd)) AS fwd FROM (SELECT s.as_of, s.ticker, value, fwd, count(*) OVER (PARTITION BY s.as_of) AS n FROM {_NAMES[signal]} s JOIN forward_returns f ON f.as_of = s.as_of AND f.ticker = s.ticker) r
      JOIN (SELECT s.as_of, quantile_cont(fwd, 0.01) AS lo, quantile_cont(fwd, 0.99) AS hi FROM {_NAMES[signal]} s JOIN forward_returns f ON f.as_of = s.as_of AND f.ticker = s.ticker GROUP BY 1) q ON q.as_of = r.as_of WHERE n >= 30"""


def _ics(signal: str) -> str:
    return f"SELECT as_of, count(*) AS n, corr(a, b) AS ic FROM (SELECT as_of, {_avg_rank('value', 'as_of')} AS a, {_avg_rank('fwd', 'as_of')} AS b FROM section_{signal}) GROUP BY as_of"


def _summary(signal: str) -> str:
    label = "CAST(round(value) AS INTEGER)" if signal == "piotroski" else _BIN
    return f"""SELECT '{signal}' AS signal, n_rebalances, {R('m')} AS mean_ic, {R('CASE WHEN s > 0 THEN m / s END')} AS ic_ir, {R('hit')} AS ic_hit_rate, {R('mono')} AS monotonicity, {R('tmb')} AS top_minus_bottom, {R('late')} AS holdout_mean_ic, true AS survivorship_biased
      FROM (SELECT count(*) AS n_rebalances, avg(ic) AS m, stddev_pop(ic) AS s, count(*) FILTER (ic > 0) / count(*) AS hit, avg(ic) FILTER (as_of >= DATE '{HOLDOUT}') AS late FROM ics_{signal}),
        (SELECT corr(a, b) AS mono, arg_max(m, bin) - arg_min(m, bin) AS tmb FROM (SELECT bin, m, {_avg_rank('bin', '1')} AS a, {_avg_rank('m', '1')} AS b FROM (
          SELECT bin, avg(m) AS m FROM (SELECT as_of, bin, avg(fwd) AS m FROM (SELECT *, {label} AS bin FROM section_{signal}) GROUP BY 1, 2) GROUP BY bin)))"""


def _annual() -> str:
    """Each of the three statements ranked by itself among those known, then joined."""
    sides = {"income": (INCOME, "income"), "balance": (BALANCE, "balance"), "cash_flow": (CASH_FLOW, "cash_flow")}
    ranked = lambda source: f"""SELECT p.as_of, s.*, row_number() OVER (PARTITION BY p.as_of, p.ticker ORDER BY date DESC) AS rank
      FROM probes p JOIN {source} s ON s.ticker = p.ticker WHERE s.known <= p.as_of"""  # noqa: E731
    known, number = "coalesce(filing_date, date + 45)", "(CAST(ticker AS INTEGER) + year(date))"
    values = ", ".join([f"{n}.date AS {n}_date" for n in sides] + [f"{n}.{c}" for n, (columns, _) in sides.items() for c in columns])
    return f"""WITH income AS (SELECT *, {known} AS known FROM statements_x),
      balance AS (SELECT *, {known} + CASE WHEN {number} % 3 = 0 THEN 385 ELSE 20 END AS known FROM statements_x),
      cash_flow AS (SELECT *, {known} AS known FROM statements_x WHERE {number} % 4 <> 0)
      SELECT income.as_of, income.ticker, income.rank, {values} FROM ({ranked("income")}) income
      JOIN ({ranked("balance")}) balance USING (as_of, ticker, rank) JOIN ({ranked("cash_flow")}) cash_flow USING (as_of, ticker, rank) WHERE income.rank <= 2"""


_MONTHS = f"SELECT last_day(CAST(d AS DATE)) AS as_of FROM (SELECT unnest(generate_series(date_trunc('month', DATE '{START}'), date_trunc('month', DATE '{END}'), INTERVAL 1 MONTH)) AS d)"
DEFINED |= {
    "rebalance_dates": _MONTHS,
    "probes": "SELECT CAST(s_suppkey AS VARCHAR) AS ticker, as_of FROM supplier, rebalance_dates",
    "prices_asof": _at(0, "px"),
    "px_recent": _at(30, "recent"),
    "px_old": _at(365, "old"),
    "shares_asof": "SELECT p.as_of, p.ticker, s.shares FROM probes p ASOF JOIN (SELECT * FROM statements_x WHERE shares > 0) s ON s.ticker = p.ticker AND s.date <= p.as_of",
    "shares_then": "SELECT p.as_of, p.ticker, s.shares FROM (SELECT *, as_of - 365 AS at FROM probes) p ASOF JOIN (SELECT * FROM statements_x WHERE shares > 0) s ON s.ticker = p.ticker AND s.date <= p.at",
    "market_cap_asof": f"SELECT p.as_of, p.ticker, {R('px * shares', 2)} AS market_cap FROM prices_asof p JOIN shares_asof s ON s.as_of = p.as_of AND s.ticker = p.ticker",
    "benchmark_return": f"""SELECT as_of, {R('next_px / nullif(px, 0) - 1', 8)} AS ret FROM (SELECT d.as_of, px, lead(px) OVER w AS next_px, lead(d.as_of) OVER w AS nxt FROM rebalance_dates d
      LEFT JOIN (SELECT * FROM prices_asof WHERE ticker = '1') p ON p.as_of = d.as_of WINDOW w AS (ORDER BY d.as_of)) WHERE nxt IS NOT NULL""",
    "universe_pit": f"SELECT as_of, ticker FROM prices_asof WHERE NOT (CAST(ticker AS INTEGER) % 10 = 7 AND as_of >= DATE '{DELISTED}') AND px >= 5.0",
    "latest_statement": _statement(1),
    "second_statement": _statement(2),
    "held": "SELECT s.* FROM latest_statement s SEMI JOIN universe_pit u ON u.as_of = s.as_of AND u.ticker = s.ticker",
    "held_then": "SELECT s.* FROM second_statement s SEMI JOIN universe_pit u ON u.as_of = s.as_of AND u.ticker = s.ticker",
    "bt_momentum": f"""SELECT r.as_of, r.ticker, {R('recent / nullif(old, 0) - 1', 8)} AS value FROM px_recent r JOIN px_old o ON o.as_of = r.as_of AND o.ticker = r.ticker JOIN universe_pit u ON u.as_of = r.as_of AND u.ticker = r.ticker""",
    "bt_quality": f"""SELECT as_of, ticker, {R('v', 6)} AS value FROM (SELECT as_of, ticker, {_z('roe', 'gm')} AS v FROM (SELECT *, {R('net_income / nullif(total_stockholder_equity, 0)', 8)} AS roe, {R('gross_profit / nullif(total_revenue, 0)', 8)} AS gm FROM held)
      WINDOW w AS (PARTITION BY as_of)) WHERE v IS NOT NULL""",
    "bt_value": f"""SELECT as_of, ticker, {R('v', 6)} AS value FROM (SELECT as_of, ticker, {_z('ey', 'fy', 'ee')} AS v FROM (SELECT h.as_of, h.ticker, {R('net_income / nullif(market_cap, 0)', 10)} AS ey, {R('free_cash_flow / nullif(market_cap, 0)', 10)} AS fy,
        {R('ebitda / nullif(market_cap + coalesce(long_term_debt, 0.0::DOUBLE) - coalesce(cash, 0.0::DOUBLE), 0)', 10)} AS ee FROM held h JOIN market_cap_asof m ON m.as_of = h.as_of AND m.ticker = h.ticker) WINDOW w AS (PARTITION BY as_of)) WHERE v IS NOT NULL""",
    "bt_piotroski": f"""SELECT n.as_of, n.ticker, CAST({" + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in ("roa_now > 0", "operating_cash_flow > 0", "roa_now > roa_then", "operating_cash_flow > net_income", "leverage_now < leverage_then",
        "current_now > current_then", "s.shares <= q.shares", "margin_now > margin_then", "turnover_now > turnover_then"))} AS DOUBLE) AS value
      FROM (SELECT as_of, ticker, operating_cash_flow, net_income, {_parts('now')} FROM held) n JOIN (SELECT as_of, ticker, {_parts('then')} FROM held_then) t ON t.as_of = n.as_of AND t.ticker = n.ticker
      LEFT JOIN shares_asof s ON s.as_of = n.as_of AND s.ticker = n.ticker LEFT JOIN shares_then q ON q.as_of = n.as_of AND q.ticker = n.ticker""",
    "bt_value_piotroski": f"""SELECT as_of, ticker, {R('v', 6)} AS value FROM (SELECT as_of, ticker, {_z('a', 'b')} AS v FROM (SELECT v.as_of, v.ticker, v.value AS a, p.value AS b FROM bt_value v JOIN bt_piotroski p ON p.as_of = v.as_of AND p.ticker = v.ticker)
      WINDOW w AS (PARTITION BY as_of)) WHERE v IS NOT NULL""",
    "forward_returns": f"""SELECT p.as_of, ticker, {R('next_px / nullif(px, 0) - 1 - coalesce(ret, 0.0::DOUBLE)', 8)} AS fwd FROM (SELECT *, lead(px) OVER w AS next_px, lead(as_of) OVER w AS nxt FROM prices_asof WINDOW w AS (PARTITION BY ticker ORDER BY as_of)) p
      LEFT JOIN benchmark_return b ON b.as_of = p.as_of WHERE nxt = last_day(p.as_of + INTERVAL 1 MONTH) AND next_px / nullif(px, 0) IS NOT NULL""",
    **{f"section_{s}": _section(s) for s in _NAMES},
    **{f"ics_{s}": _ics(s) for s in _NAMES},
}

SQL = {
    "rebalance_dates": f"SELECT DISTINCT last_day(date) AS as_of FROM eod_prices_x WHERE date >= DATE '{START}' AND last_day(date) <= DATE '{END}'",
    **{n: f"SELECT * FROM {n}" for n in ("prices_asof", "shares_asof", "market_cap_asof", "benchmark_return", "universe_pit", "latest_statement", "forward_returns", *_NAMES.values())},
    "annual_fundamentals": _annual(),
    "ic_decile": f"""SELECT b.as_of, bin, b.n, mean_fwd, {R('ic', 6)} AS ic FROM (SELECT as_of, bin, count(*) AS n, {R(f"CAST(sum(CAST({R('fwd', 8)} AS DECIMAL(18,8))) AS DOUBLE) / count(*)", 6)} AS mean_fwd FROM (SELECT *, {_BIN} AS bin FROM section_momentum) GROUP BY 1, 2) b
      JOIN ics_momentum i ON i.as_of = b.as_of""",
    "backtest_summary": " UNION ALL ".join(_summary(s) for s in _NAMES),
    "interaction_diagnostic": f"""WITH r AS (SELECT v.as_of, v.ticker, v.value AS v, p.value AS f, fwd, count(*) OVER (PARTITION BY v.as_of) AS n FROM bt_value v JOIN bt_piotroski p ON p.as_of = v.as_of AND p.ticker = v.ticker JOIN forward_returns q ON q.as_of = v.as_of AND q.ticker = v.ticker),
      e AS (SELECT as_of, quantile_cont(fwd, 0.01) AS lo, quantile_cont(fwd, 0.99) AS hi, quantile_cont(v, 0.5) AS mid FROM r GROUP BY as_of),
      h AS (SELECT r.as_of, f, greatest(lo, least(hi, fwd)) AS fwd, CASE WHEN v >= mid - 1e-9 THEN 'cheap' ELSE 'dear' END AS half FROM r JOIN e ON e.as_of = r.as_of WHERE n >= 40)
      SELECT * FROM (SELECT as_of, half, count(*) AS n, {R('corr(a, b)')} AS ic FROM (SELECT as_of, half, {_avg_rank('f', 'as_of, half')} AS a, {_avg_rank('fwd', 'as_of, half')} AS b FROM h) GROUP BY 1, 2 HAVING count(*) >= 20) WHERE ic IS NOT NULL AND NOT isnan(ic)""",
}
