"""Table functions: SQL asks for a plan at a date or for a name, by named parameters that are checked.

register() makes temporary views of the derived tables and SQL functions over them, so a call is planned as one query with its surroundings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.sources.domain import Tables

from . import flows

VIEWS = ("eod_prices", "fundamentals", "institutional_holders")


def _p(name: str) -> str:
    """A parameter, or an error where it is null."""
    return f"coalesce({name}, raise_error('{name} must be given'))"


# The lags of price performance, in trading days.
_LAGS = {"1d": 1, "5d": 5, "1m": 21, "3m": 63, "12m": 252}


def _change(before: str) -> str:
    return f"CASE WHEN {before} > 0 THEN floor((close / {before} - 1) * 100.0 * 1e2 + 0.5) / 1e2 END"


FUNCTIONS: dict[str, tuple[str, str]] = {
    "price_perf_at": (
        "as_of_day DATE, max_days INT DEFAULT 400",
        f"""SELECT ticker, date AS as_of, close, {', '.join(f'{_change(f"c_{n}")} AS ret_{n}' for n in _LAGS)}
        FROM (SELECT ticker, date, adjusted_close AS close, {', '.join(f'lag(adjusted_close, {k}) OVER w AS c_{n}' for n, k in _LAGS.items())},
              lead(date) OVER w AS next
            FROM m_eod_prices
            WHERE date <= {_p('as_of_day')} AND date >= date_sub({_p('as_of_day')}, {_p('max_days')}) AND adjusted_close > 0
            WINDOW w AS (PARTITION BY ticker ORDER BY date))
        WHERE next IS NULL""",
    ),
    "prices_between": (
        "symbol STRING, since DATE DEFAULT DATE'1900-01-01', until DATE DEFAULT DATE'9999-12-31'",
        f"SELECT ticker, date, close, volume FROM m_eod_prices WHERE ticker = {_p('symbol')} AND date BETWEEN {_p('since')} AND {_p('until')}",
    ),
    "vintages_at": (
        "as_of_day DATE",
        f"""SELECT ticker, max_by(net_change_pct, banked_at) AS net_change_pct, max(banked_at) AS banked_at
        FROM m_vintages WHERE banked_at <= {_p('as_of_day')} GROUP BY ticker""",
    ),
    "momentum_leaders": (
        "as_of_day DATE, min_return DOUBLE DEFAULT 0, min_mcap DOUBLE DEFAULT 0",
        f"""SELECT p.ticker, f.name, f.sector, p.close, p.ret_3m FROM price_perf_at(as_of_day) AS p JOIN m_fundamentals AS f ON f.ticker = p.ticker
        WHERE p.ret_3m > {_p('min_return')} AND f.market_cap >= {_p('min_mcap')} AND NOT f.is_delisted""",
    ),
}


def register(t: Tables) -> SparkSession:
    """The functions of this module in the session, over the tables of t."""
    for name in VIEWS:
        getattr(t, name).createOrReplaceTempView(f"m_{name}")
    flows.vintages(t).createOrReplaceTempView("m_vintages")
    for name, (parameters, body) in FUNCTIONS.items():
        t.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE RETURN {body}")
    return t.spark


def _call(sql: str, **args):
    def plan(t: Tables) -> DataFrame:
        return register(t).sql(sql, args=args)

    return plan


PLANS = {
    "price_perf_at": _call("SELECT * FROM price_perf_at(as_of_day => CAST(:day AS DATE))", day="2000-12-15"),
    "prices_between": _call("SELECT * FROM prices_between(symbol => :symbol, until => CAST(:until AS DATE))", symbol="Brand#12", until="1998-06-30"),
    "vintages_at": _call("SELECT * FROM vintages_at(CAST(:day AS DATE))", day="2001-06-30"),
    "momentum_leaders": _call("SELECT * FROM momentum_leaders(CAST(:day AS DATE), min_mcap => CAST(:cap AS DOUBLE))", day="2001-06-30", cap="1e8"),
}


def _perf_sql(day: str) -> str:
    change = lambda c: f"CASE WHEN {c} > 0 THEN floor((close / {c} - 1) * 100.0 * 1e2 + 0.5) / 1e2 END"
    return f"""SELECT ticker, date AS as_of, close, {', '.join(f'{change(f"c_{n}")} AS ret_{n}' for n in _LAGS)} FROM (
      SELECT ticker, date, adjusted_close AS close, {', '.join(f'lag(adjusted_close, {k}) OVER w AS c_{n}' for n, k in _LAGS.items())}, lead(date) OVER w AS next
      FROM eod_prices WHERE date <= DATE '{day}' AND date >= DATE '{day}' - 400 AND adjusted_close > 0 WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE next IS NULL"""


def sql(vintages: str) -> dict[str, str]:
    """SQL for another engine; vintages is the definition of the table of that name."""
    return {
        "price_perf_at": _perf_sql("2000-12-15"),
        "prices_between": "SELECT ticker, date, close, volume FROM eod_prices WHERE ticker = 'Brand#12' AND date <= DATE '1998-06-30'",
        "vintages_at": f"""WITH {vintages} SELECT ticker, net_change_pct, banked_at FROM vintages WHERE banked_at <= DATE '2001-06-30'
          QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY banked_at DESC) = 1""",
        "momentum_leaders": f"SELECT p.ticker, f.name, f.sector, p.close, p.ret_3m FROM ({_perf_sql('2001-06-30')}) p JOIN fundamentals f ON f.ticker = p.ticker WHERE p.ret_3m > 0 AND f.market_cap >= 1e8 AND NOT f.is_delisted",
    }
