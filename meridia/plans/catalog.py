"""All queries over the derived tables, and their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.sources.domain import AS_OF, Tables

from . import audits, backtest, dashboard, flows, functions, newsletter, oracle_backtest, oracle_newsletter, oracle_rest, oracle_ssg, oracle_strategies, payloads, portfolio, reference_data, signals, ssg, stored, strategies, tabs, writes
from .oracle import oracle

PLANS: dict[str, Callable[[Tables], DataFrame]] = {
    "eod_prices": lambda t: t.eod_prices,
    "fundamentals": lambda t: t.fundamentals,
    "statements": lambda t: t.statements,
    "earnings_history": lambda t: t.earnings_history,
    "inst_flow": flows.inst_flow,
    "fund_flow": flows.fund_flow,
    "inst_flow_ticker": flows.inst_flow_ticker,
    "fund_flow_ticker": flows.fund_flow_ticker,
    "price_perf": flows.price_perf,
    "bank_vintages": flows.vintages,
    "bank_fund_vintages": flows.fund_vintages,
    "vintage_asof": lambda t: flows.vintage_asof(flows.vintages(t), AS_OF),
    **strategies.STRATEGIES,
    "multi_signal": strategies.multi_signal,
    "strategy_signals": strategies.strategy_signals,
    "conviction_facts": strategies.conviction_facts,
    "drawn_run": strategies.drawn_run,
    "drawn_signals": strategies.drawn_signals,
    "drawn_picks": newsletter.drawn_picks,
    **newsletter.SECTIONS,
    "newsletter_payload": newsletter.newsletter_payload,
    "newsletter_findings": newsletter.newsletter_findings,
    **backtest.PLANS,
    **signals.PLANS,
    **portfolio.PLANS,
    **ssg.PLANS,
    **writes.PLANS,
    **stored.PLANS,
    **tabs.PLANS,
    **audits.PLANS,
    **functions.PLANS,
    **reference_data.PLANS,
    **payloads.PLANS,
    **dashboard.PLANS,
    "refresh_views": flows.refresh_views,
    "count_by_type": lambda t: t.fundamentals.groupBy("type").agg(F.count("*").alias("n")),
}

def _vintages(now: str, names: str, compared: list[str]) -> str:
    of = lambda side: ", ".join(f"{side}.{c}" for c in compared)
    return f"""{names}_older AS (SELECT DATE '2001-04-15' AS banked_at, * FROM {now} WHERE latest_filing <= DATE '2001-03-31'),
    {names}_moved AS (SELECT * REPLACE (CASE WHEN n_added % 2 = 0 THEN net_change_pct ELSE net_change_pct + 1 END AS net_change_pct) FROM {now}),
    {names} AS (SELECT * FROM {names}_older UNION ALL SELECT DATE '2001-06-30' AS banked_at, m.* FROM {names}_moved m LEFT JOIN {names}_older o ON o.ticker = m.ticker
      WHERE o.ticker IS NULL OR ({of('m')}) IS DISTINCT FROM ({of('o')}))"""


_VINTAGES = _vintages("inst_flow_ticker", "vintages", flows.INST_COMPARED)

SQL: dict[str, str] = {
    **{n: f"SELECT * FROM {n}" for n in ("eod_prices", "fundamentals", "statements", "earnings_history", "inst_flow", "fund_flow", "inst_flow_ticker", "fund_flow_ticker", "price_perf")},
    "bank_vintages": f"WITH {_VINTAGES} SELECT * FROM vintages",
    "bank_fund_vintages": f"WITH {_vintages('fund_flow_ticker', 'vintages', flows.FUND_COMPARED)} SELECT * FROM vintages",
    "refresh_views": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in flows.VIEWS),
    "vintage_asof": f"WITH {_VINTAGES} SELECT * FROM vintages WHERE banked_at <= DATE '2001-06-30' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY banked_at DESC) = 1",
    **oracle_strategies.SQL,
    **oracle_newsletter.SQL,
    **oracle_backtest.SQL,
    **oracle_rest.SQL,
    **oracle_ssg.SQL,
    **writes.SQL,
    **stored.SQL,
    **tabs.SQL,
    **audits.SQL,
    **functions.sql(_VINTAGES),
    **reference_data.SQL,
    "stored_study": reference_data.study_sql(oracle_ssg.SQL["ssg_study"]),
    **payloads.SQL,
    **dashboard.SQL,
}


SQL |= {
    "sig_institutional_flow": f"""WITH {_VINTAGES}, banked AS (SELECT * RENAME (banked_at AS known_at) FROM vintages WHERE banked_at <= DATE '2001-06-30' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY banked_at DESC) = 1),
      v AS (SELECT * FROM banked UNION ALL BY NAME SELECT *, observed_at AS known_at FROM inst_flow_ticker WHERE observed_at <= DATE '2001-06-30' AND ticker NOT IN (SELECT ticker FROM banked)),
      r AS (SELECT l.ticker, v.* EXCLUDE (ticker), CASE WHEN c.ticker IS NULL THEN 'not_covered' WHEN known_at IS NULL THEN 'no_vintage_as_of' WHEN v.net_change_pct IS NULL THEN 'net_change_null' WHEN v.top_n_holders < 5 THEN 'below_min_holders'
        WHEN v.holders_at_latest < 4 THEN 'below_min_holders_at_latest' WHEN v.prior_shares_at_latest < 50000 THEN 'below_min_prior_shares' END AS reason FROM listed l LEFT JOIN inst_flow_ticker c ON c.ticker = l.ticker LEFT JOIN v ON v.ticker = l.ticker)
      SELECT ticker, CASE WHEN reason IS NULL THEN net_change_pct END AS value, reason, top_n_at_cap AND net_change_pct < 0 AS reading_is_lower_bound, CAST(DATE '2001-06-30' - latest_filing AS INTEGER) AS stale_days FROM r""",
    "count_by_type": "SELECT type, count(*) AS n FROM fundamentals GROUP BY type",
}


_RATED = ("sig_momentum", "sig_value", "sig_insider", "sig_institutional_flow", "sig_ssg")
_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS signal, coalesce(reason, 'rated') AS reason FROM ({SQL[n]})" for n in _RATED)
SQL["signal_coverage"] = f"SELECT signal, reason, count(*) AS n FROM ({_COUNTS}) GROUP BY 1, 2"


def oracles() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in SQL.items()}
