"""Holder flows, their rollups by ticker, their vintages, and price performance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.numbers import half_up, pct_change
from meridia.operators.frames import in_blocks
from meridia.operators.latest import latest_by
from meridia.sources.domain import AS_OF, Tables, day, kept

WINDOW_DAYS = 95
CAP = 20


def _flow(holders: DataFrame, *more: str) -> DataFrame:
    """A first position shows as a change equal to the holding; that test comes before the sign of the change."""
    change = F.col("change_shares")
    first = (change == F.col("shares_held")) & (change != 0)
    action = F.when(first, "initiated").when(change == 0, "unchanged").when(change > 0, "added").when(change < 0, "trimmed")
    return holders.where(change.isNotNull()).select(
        "ticker", "holder_name", "report_date", "observed_at", "shares_held", "pct_shares", *more, "change_shares", "change_pct",
        (F.col("shares_held") - change).alias("prior_shares"), action.alias("action"), F.when(~first, F.col("change_pct")).alias("change_pct_clean"),
    )


def inst_flow(t: Tables) -> DataFrame:
    return _flow(t.institutional_holders, "pct_assets")


def fund_flow(t: Tables) -> DataFrame:
    return _flow(t.fund_holders)


def _anchored(flow: DataFrame) -> DataFrame:
    """The latest filing of each ticker joined to its rows: a maximum combines before the shuffle, and a skewed join can be split."""
    return flow.join(flow.groupBy("ticker").agg(F.max("report_date").alias("latest_filing")), "ticker")


def _net(inside: Column) -> tuple[Column, Column, Column]:
    change, prior = F.sum(F.when(inside, F.col("change_shares"))), F.sum(F.when(inside, F.col("prior_shares")))
    return change, prior, F.when(prior > 0, half_up(change / prior * 100.0, 2))


def _actions(inside: Column, *names: str) -> list[Column]:
    return [F.count_if(inside & (F.col("action") == a)).alias(f"n_{a}") for a in names]


@kept
def inst_flow_ticker(t: Tables) -> DataFrame:
    now = F.col("report_date") == F.col("latest_filing")
    change, prior, net = _net(now)
    return _anchored(inst_flow(t)).groupBy("ticker", "latest_filing").agg(
        F.min("report_date").alias("earliest_filing"), F.max("observed_at").alias("observed_at"), F.count("*").alias("top_n_holders"), (F.count("*") >= CAP).alias("top_n_at_cap"),
        F.count_if(now).alias("holders_at_latest"), F.count_if(~now).alias("holders_lagging"), F.sum("shares_held").alias("top_n_shares"),
        half_up(F.sum(F.col("pct_shares").cast("decimal(18,4)")).cast("double")).alias("top_n_pct_of_shares_out"), half_up(F.max("pct_shares")).alias("largest_holder_pct"),
        half_up(F.max("pct_assets")).alias("max_holder_conviction_pct"), change.alias("net_change_shares"), prior.alias("prior_shares_at_latest"), net.alias("net_change_pct"),
        *_actions(now, "added", "trimmed", "initiated", "unchanged"),
    )


@kept
def fund_flow_ticker(t: Tables) -> DataFrame:
    inside = F.col("report_date") >= F.date_sub("latest_filing", WINDOW_DAYS)
    change, prior, net = _net(inside)
    earliest = F.min(F.when(inside, F.col("report_date")))
    return _anchored(fund_flow(t)).groupBy("ticker", "latest_filing").agg(
        earliest.alias("window_earliest_filing"), F.datediff(F.max("latest_filing"), earliest).cast("bigint").alias("filing_span_days"), F.max("observed_at").alias("observed_at"),
        F.count("*").alias("top_n_funds"), F.count_if(inside).alias("funds_in_window"), F.count_if(~inside).alias("funds_stale"), F.sum("shares_held").alias("top_n_shares"),
        half_up(F.sum(F.col("pct_shares").cast("decimal(18,4)")).cast("double")).alias("top_n_pct_of_shares_out"), change.alias("net_change_shares"), prior.alias("prior_shares_in_window"),
        net.alias("net_change_pct"), *_actions(inside, "initiated", "added", "trimmed"),
    )


@kept
def price_perf(t: Tables) -> DataFrame:
    """Latest price of each held ticker with returns over trading-day lags; the date floor is below the windows."""
    universe = t.institutional_holders.select("ticker").distinct()
    recent = t.eod_prices.where((F.col("date") >= F.date_sub(day(AS_OF), 400)) & (F.col("adjusted_close") > 0)).join(universe, "ticker", "left_semi")
    close, volume = F.col("adjusted_close"), F.col("avg_vol")
    lags = {"1d": 1, "5d": 5, "1m": 21, "3m": 63, "12m": 252}
    frames = {f"c_{n}": (lambda w, k=k: F.lag("adjusted_close", k).over(w)) for n, k in lags.items()}
    frames |= {"avg_vol": lambda w: F.avg("volume").over(w.rowsBetween(-20, -1)), "next": lambda w: F.lead("date").over(w)}
    wide = in_blocks(recent.select("ticker", "date", "adjusted_close", "volume"), ["ticker"], "date", frames, back=252, ahead=1)
    return wide.where("next is null").select(
        "ticker", F.col("date").alias("as_of"), close.alias("close"), "volume", F.floor(volume + 0.5).cast("double").alias("avg_vol_20d"),
        F.when(volume > 0, half_up(F.col("volume") / volume, 2)).alias("vol_ratio"), *[pct_change(close, F.col(f"c_{n}")).alias(f"ret_{n}") for n in lags],
    )


# A ticker is banked again when one of these has moved.
INST_COMPARED = ["net_change_pct", "latest_filing", "top_n_holders", "largest_holder_pct", "max_holder_conviction_pct"]
FUND_COMPARED = ["net_change_pct", "latest_filing", "top_n_funds"]


def bank_vintages(current: DataFrame, banked: DataFrame, banked_at: str, compared: list[str]) -> DataFrame:
    """The rows of current that are new or differ from the last banked ones in a compared column; one vintage a ticker and day."""
    last = latest_by(banked, ["ticker"], ["banked_at"], compared).select("ticker", F.lit(True).alias("_known"), F.col("banked_at").alias("_at"), *[F.col(c).alias(f"_{c}") for c in compared])
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = current.join(last, "ticker", "left")
    fresh = F.col("_known").isNull() | (~same & (F.col("_at") < day(banked_at)))
    return joined.where(fresh).select(day(banked_at).alias("banked_at"), *current.columns)


def _two_vintages(now: DataFrame, moves: str, compared: list[str]) -> DataFrame:
    """All tickers as they would have stood in March, and in June those that moved since: of those, the ones with odd counts of `moves`."""
    older = now.where("latest_filing <= date '2001-03-31'").select(day("2001-04-15").alias("banked_at"), *now.columns)
    moved = F.when(F.col(moves) % 2 == 0, F.col("net_change_pct")).otherwise(F.col("net_change_pct") + 1)
    return older.unionByName(bank_vintages(now.withColumn("net_change_pct", moved), older, AS_OF, compared))


def vintages(t: Tables) -> DataFrame:
    return _two_vintages(inst_flow_ticker(t), "n_added", INST_COMPARED)


def fund_vintages(t: Tables) -> DataFrame:
    return _two_vintages(fund_flow_ticker(t), "n_added", FUND_COMPARED)


def vintage_asof(banked: DataFrame, as_of: str) -> DataFrame:
    return latest_by(banked.where(F.col("banked_at") <= day(as_of)), ["ticker"], ["banked_at"])


#: Kept tables in the order in which they need each other.
VIEWS = {
    **{n: (lambda t, n=n: getattr(t, n)) for n in ("fundamentals", "eod_prices", "institutional_holders", "fund_holders", "statements", "earnings_history", "analyst_ratings", "dividends")},
    "inst_flow_ticker": inst_flow_ticker,
    "fund_flow_ticker": fund_flow_ticker,
    "price_perf": price_perf,
}


def refresh_views(t: Tables) -> DataFrame:
    """Derives the kept tables anew, in order; name and n_rows of each. Readers of the old files are not disturbed."""
    t.forget()
    made = [view(t).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, view in VIEWS.items()]
    return reduce(DataFrame.unionByName, made)
