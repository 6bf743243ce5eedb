"""Signals for all tickers at once: value, or the first reason why a ticker cannot be ranked.

A null value means not rankable, never zero; a value of 0 is a reading. Flags travel beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.numbers import half_up
from meridia.operators.latest import as_of_join, latest_by
from meridia.operators.ordered import placed
from meridia.sources.domain import AS_OF, CONFIG, EVENTS_AS_OF, Tables, day

from . import flows


def universe_select(t: Tables, exchange: str | None = None, sector: str | None = None, min_mcap: float | None = None, limit: int | None = None) -> DataFrame:
    """Listed common stock, types unknown included, by market cap."""
    f = t.fundamentals.where(~F.col("is_delisted") & (F.col("type").isNull() | F.col("type").ilike("common stock")))
    for condition, given in ((F.col("exchange") == exchange, exchange), (F.col("sector") == sector, sector), (F.col("market_cap") >= (min_mcap or 0), min_mcap)):
        f = f if given is None else f.where(condition)
    f = f.orderBy(F.desc_nulls_last("market_cap"), "ticker")
    return (f.limit(limit) if limit else f).select("ticker", "market_cap")


def _first_reason(*tests: tuple[Column, str]) -> Column:
    out = None
    for test, reason in tests:
        out = F.when(test, reason) if out is None else out.when(test, reason)
    return out


def _rated(df: DataFrame, reason: Column, value: Column, *more: str | Column) -> DataFrame:
    rows = df.withColumn("reason", reason)
    return rows.select("ticker", F.when(F.col("reason").isNull(), value).alias("value"), "reason", *more)


def _months_before(date: Column, months: int) -> Column:
    """The same day of an earlier month, the 28th at the latest."""
    first = F.add_months(F.trunc(date, "MONTH"), -months)
    return F.date_add(first, F.least(F.day(date), F.lit(28)) - 1)


def sig_momentum(t: Tables, lookback: int = 12, skip: int = 1, gap: int = 10, as_of: str = AS_OF) -> DataFrame:
    at = day(as_of)
    targets = {"recent": _months_before(at, skip), "old": _months_before(at, lookback)}
    tickers = universe_select(t).select("ticker")
    asked = tickers.select("ticker", F.explode(F.array(*[F.struct(F.lit(n).alias("leg"), d.alias("target")) for n, d in targets.items()])).alias("p")).select("ticker", "p.*")
    prices = t.eod_prices.where((F.col("adjusted_close") > 0) & (F.col("date") <= at) & (F.col("date") >= F.date_sub(targets["old"], gap + 5)))
    found = as_of_join(asked, prices, ["ticker"], "target", "date", {"p": "adjusted_close"}, at="found")
    leg = lambda n, c: F.max(F.when(F.col("leg") == n, F.col(c)))
    legs = found.withColumn("gap", F.datediff("target", "found")).groupBy("ticker").agg(*[leg(n, c).alias(f"{c}_{n}") for n in targets for c in ("p", "gap", "found")])
    reason = _first_reason((F.col("p_recent").isNull() | F.col("p_old").isNull(), "insufficient_price_history"), ((F.col("gap_recent") > gap) | (F.col("gap_old") > gap), "stale_price_window"))
    return _rated(legs, reason, half_up(F.col("p_recent") / F.col("p_old") - 1.0, 6), F.col("found_recent").alias("recent_price_date"), F.col("found_old").alias("old_price_date"))


def sig_value(t: Tables, quarters: int = 4, as_of: str = AS_OF) -> DataFrame:
    """Trailing earnings yield; quarters count from the day they were reported."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    eps = t.earnings_history.where((F.col("report_date") <= day(as_of)) & F.col("eps_actual").isNotNull()).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= quarters)
    ttm = eps.groupBy("ticker").agg(F.sum(F.col("eps_actual").cast("decimal(18,4)")).cast("double").alias("ttm"), F.count("*").alias("n_quarters"), F.max("date").alias("latest_earnings_date"))
    price = latest_by(t.eod_prices.where((F.col("adjusted_close") > 0) & (F.col("date") <= day(as_of))), ["ticker"], ["date"], ["adjusted_close"]).drop("date")
    rows = universe_select(t).select("ticker").join(ttm, "ticker", "left").join(price, "ticker", "left")
    reason = _first_reason((F.coalesce("n_quarters", F.lit(0)) < quarters, "insufficient_eps_history"), (F.col("adjusted_close").isNull(), "no_price"))
    return _rated(rows, reason, half_up(F.col("ttm") / F.col("adjusted_close"), 8), (F.col("ttm") < 0).alias("negative_earnings"), "latest_earnings_date")


def sig_insider(t: Tables, window: int = 30, lag: int = 4, min_txns: int = 2, as_of: str = EVENTS_AS_OF) -> DataFrame:
    """Buys less sells in (as_of - window, as_of] that were knowable: by report date, else some days after the trade."""
    at = day(as_of)
    knowable = F.coalesce("report_date", F.date_add("transaction_date", lag))
    rows = t.insider_transactions.where(
        F.col("transaction_code").isin("P", "S") & F.col("value").isNotNull() & (F.col("transaction_date") > F.date_sub(at, window)) & (F.col("transaction_date") <= at) & (knowable <= at)
    )
    value = lambda c: F.sum(F.when(F.col("transaction_code") == c, F.col("value").cast("decimal(18,2)")).otherwise(0)).cast("double")
    agg = rows.groupBy("ticker").agg(F.count("*").alias("n_txns"), F.count_distinct("owner_name").alias("n_insiders"), value("P").alias("buy_value"), value("S").alias("sell_value"))
    agg = universe_select(t).select("ticker").join(agg, "ticker", "left")
    n, net = F.coalesce("n_txns", F.lit(0)), half_up(F.col("buy_value") - F.col("sell_value"), 2)
    direction = F.when(net > 0, "net_buying").when(net < 0, "net_selling").when(net == 0, "net_flat")
    return _rated(agg, _first_reason((n == 0, "no_activity"), (n < min_txns, "below_min_txns")), net, n.alias("n_txns"), "n_insiders", direction.alias("direction"), (net < 0).alias("sales_are_noisier"))


def sig_institutional_flow(t: Tables, as_of: str = AS_OF, banked: DataFrame | None = None) -> DataFrame:
    """Net change from the last vintage banked by as_of, live data otherwise if it was observed by then."""
    banked = flows.vintage_asof(flows.vintages(t) if banked is None else banked, as_of).withColumn("known_at", F.col("banked_at")).drop("banked_at")
    live = flows.inst_flow_ticker(t).withColumn("known_at", F.col("observed_at"))
    live = live.where(F.col("known_at") <= day(as_of)).join(banked.select("ticker"), "ticker", "left_anti")
    covered = flows.inst_flow_ticker(t).select("ticker", F.lit(True).alias("covered"))
    rows = universe_select(t).select("ticker").join(covered, "ticker", "left").join(banked.unionByName(live), "ticker", "left")
    reason = _first_reason(
        (F.col("covered").isNull(), "not_covered"), (F.col("known_at").isNull(), "no_vintage_as_of"), (F.col("net_change_pct").isNull(), "net_change_null"), (F.col("top_n_holders") < CONFIG["min_holders"], "below_min_holders"),
        (F.col("holders_at_latest") < CONFIG["min_holders_at_latest"], "below_min_holders_at_latest"), (F.col("prior_shares_at_latest") < CONFIG["min_prior_shares"], "below_min_prior_shares"),
    )
    bound = F.col("top_n_at_cap") & (F.col("net_change_pct") < 0)
    return _rated(rows, reason, F.col("net_change_pct"), bound.alias("reading_is_lower_bound"), F.datediff(day(as_of), F.col("latest_filing")).alias("stale_days"))


def sig_ssg(t: Tables, as_of: str = AS_OF, today: str = AS_OF) -> DataFrame:
    """Projected total return of the study. It knows the present only, so an earlier as_of excludes every ticker."""
    from .ssg import ssg_study

    rows = universe_select(t).select("ticker").join(ssg_study(t).select("ticker", "total_return", F.lit(True).alias("covered")), "ticker", "left")
    reason = _first_reason((day(as_of) < day(today), "no_pit_fundamentals"), (F.col("covered").isNull(), "not_covered"), (F.col("total_return").isNull(), "no_projection"))
    return _rated(rows, reason, F.col("total_return"))


def select_rank(signal: DataFrame, descending: bool = True) -> DataFrame:
    """Rankable tickers with ranks from 1, and how many were considered and left out."""
    order = F.desc("value") if descending else F.asc("value")
    everyone = signal.agg(F.count("*").alias("universe"), F.count("value").alias("rankable"))
    ranked = placed(signal.where("value is not null").select("ticker", "value"), [order, F.asc("ticker")])
    ranked = ranked.select("ticker", "value", F.col("_place").cast("int").alias("rank"))
    return ranked.crossJoin(everyone).withColumn("excluded", F.col("universe") - F.col("rankable"))  # one row of counts


Signal = Callable[..., DataFrame]


class Registry:
    """Signals by name; a new one is added with register(), which also serves as a decorator."""

    def __init__(self) -> None:
        self._known: dict[str, Signal] = {}

    def register(self, signal: Signal, name: str | None = None) -> Signal:
        name = name or signal.__name__
        if name in self._known:
            raise ValueError(f"there is a signal {name} already")
        self._known[name] = signal
        return signal

    def __getitem__(self, name: str) -> Signal:
        if name not in self._known:
            raise KeyError(f"no signal {name}; there are {', '.join(self._known) or 'none'}")
        return self._known[name]

    def names(self) -> list[str]:
        return list(self._known)


REGISTRY = Registry()
for _signal in (sig_momentum, sig_value, sig_insider, sig_institutional_flow, sig_ssg):
    REGISTRY.register(_signal)


def coverage(t: Tables) -> DataFrame:
    """For each registered signal how many tickers it rates, and how many it leaves out for each reason."""
    rows = [REGISTRY[name](t).select(F.lit(name).alias("signal"), "reason", "value") for name in REGISTRY.names()]
    return reduce(DataFrame.unionByName, rows).groupBy("signal", F.coalesce("reason", F.lit("rated")).alias("reason")).agg(F.count("*").alias("n"))


PLANS = {
    "signal_coverage": coverage,
    "universe_select": universe_select,
    "sig_momentum": sig_momentum,
    "sig_value": sig_value,
    "sig_insider": sig_insider,
    "sig_institutional_flow": sig_institutional_flow,
    "sig_ssg": sig_ssg,
    "select_rank": lambda t: select_rank(sig_value(t)),
}

