"""Factor backtests for all rebalance dates at once: every table is keyed by (as_of, ticker), nothing loops over dates.

The cross-section is the wider one, suppliers as tickers. Prices at the dates and before them come from one as-of
pass; signals are one long table (signal, as_of, ticker, value), joined once to forward returns, and all statistics
are keyed by signal. These tables are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.numbers import half_up, ratio
from meridia.operators.frames import Source, latest_as_of
from meridia.operators.latest import as_of_join
from meridia.operators.ordered import percentiles
from meridia.operators.stats import equal_bins, finite, rank_correlation, winsorise, z_scores
from meridia.sources.domain import Tables, day, kept
from meridia.sources.workspace import written

START, END, HOLDOUT = "1999-01-31", "2001-06-30", "2000-12-31"
# Days that a price counts for in the universe and elsewhere, least price, days from a period's end to its filing.
UNIVERSE_DAYS, PRICE_DAYS, FLOOR, LAG = 7, 10, 5.0, 45
BENCHMARK_X = "1"
DELISTED = "2000-06-30"
DATE = ["as_of"]
KEY = ["as_of", "ticker"]
#: Days before a rebalance date at which prices are looked up.
LEGS = {"px": 0, "recent": 30, "old": 365}
#: Days before a lookup from which prices are read; staleness is asked for up to here.
REACH = 90


def month_ends() -> Column:
    months = F.sequence(F.trunc(day(START), "MONTH"), F.trunc(day(END), "MONTH"), F.expr("interval 1 month"))
    return F.explode(F.transform(months, lambda d: F.last_day(d)))


def rebalance_dates(t: Tables) -> DataFrame:
    """The ends of the months of the backtest in which anything was priced."""
    end = F.last_day("date")
    priced = t.lines.where((F.col("date") >= day(START)) & (end <= day(END)))
    return priced.select(end.alias("as_of")).distinct()


def calendar(t: Tables) -> DataFrame:
    return t.spark.range(1).select(month_ends().alias("as_of"))


def probes(t: Tables) -> DataFrame:
    """Every ticker at every date."""
    return t.read("supplier").select(F.col("s_suppkey").cast("string").alias("ticker")).select("ticker", month_ends().alias("as_of"))


@kept
def probed_prices(t: Tables) -> DataFrame:
    """as_of, ticker, and for each leg the last price up to it and its age in days there, of prices not older than REACH at the earliest lookup."""
    legs = F.explode(F.array(*[F.struct(F.lit(n).alias("leg"), F.lit(back).alias("back")) for n, back in LEGS.items()])).alias("p")
    asked = probes(t).select(*KEY, legs).select(*KEY, "p.leg", F.date_sub("as_of", F.col("p.back")).alias("_at"))
    first = F.date_sub(day(START), max(LEGS.values()) + REACH)
    prices = t.eod_prices_x.where((F.col("date") >= first) & (F.col("date") <= day(END)))
    found = as_of_join(asked, prices, ["ticker"], "_at", "date", {"price": "adjusted_close"}, at="_date")
    of = lambda leg, c: F.max(F.when(F.col("leg") == leg, c))
    age = F.datediff("_at", "_date")
    return found.groupBy(*KEY).agg(*[c for n in LEGS for c in (of(n, F.col("price")).alias(n), of(n, age).alias(f"{n}_age"))])


def prices_at(t: Tables, leg: str, days: int = PRICE_DAYS) -> DataFrame:
    """as_of, ticker and the price at a leg, if it is not stale."""
    if days > REACH:
        raise ValueError(f"prices of up to {REACH} days are at hand, not {days}")
    return probed_prices(t).where(F.col(f"{leg}_age") <= days).select(*KEY, leg)


def prices_asof(t: Tables) -> DataFrame:
    return prices_at(t, "px", t.price_days)


@kept
def probed_shares(t: Tables) -> DataFrame:
    """as_of, ticker, shares at the date and a year before. Share counts carry no filing date; the report date decides."""
    both = F.explode(F.array(F.lit(0), F.lit(365))).alias("back")
    asked = probes(t).select(*KEY, both).withColumn("_at", F.date_sub("as_of", F.col("back")))
    found = as_of_join(asked, t.statements_x.where("shares > 0"), ["ticker"], "_at", "date", {"shares": "shares"})
    of = lambda back, name: F.max(F.when(F.col("back") == back, F.col("shares"))).alias(name)
    return found.groupBy(*KEY).agg(of(0, "shares"), of(365, "s_then"))


def shares_asof(t: Tables) -> DataFrame:
    return probed_shares(t).where("shares is not null").select(*KEY, "shares")


def market_cap_asof(t: Tables) -> DataFrame:
    cap = half_up(F.col("px") * F.col("shares"), 2)
    return prices_asof(t).join(shares_asof(t), KEY).select(*KEY, cap.alias("market_cap"))


def benchmark_return(t: Tables) -> DataFrame:
    """as_of, ret to the next rebalance; null where either end is missing."""
    own = prices_asof(t).where(F.col("ticker") == BENCHMARK_X).select("as_of", "px")
    dated = calendar(t).join(own, "as_of", "left")
    w = Window.orderBy("as_of")  # a row for each date
    rows = dated.select("as_of", (ratio(F.lead("px").over(w), F.col("px")) - 1).alias("ret"), F.lead("as_of").over(w).alias("next"))
    return rows.where("next is not null").select("as_of", half_up(F.col("ret"), 8).alias("ret"))


def universe_pit(t: Tables) -> DataFrame:
    """Tickers not delisted at as_of whose recent price is above the floor."""
    gone = (F.col("ticker").cast("int") % 10 == 7) & (F.col("as_of") >= day(DELISTED))
    return prices_at(t, "px", t.universe_days).where(~gone & (F.col("px") >= FLOOR)).select(*KEY)


STATEMENT = [
    "total_revenue", "gross_profit", "net_income", "ebitda", "total_assets", "total_current_assets", "total_current_liabilities",
    "long_term_debt", "total_stockholder_equity", "cash", "free_cash_flow", "operating_cash_flow", "shares",
]


def _known() -> Column:
    return F.coalesce(F.col("filing_date"), F.date_add("date", LAG))


@kept
def known_statements(t: Tables) -> DataFrame:
    """The two latest statements of each ticker that were knowable at as_of, by place: one pass in order of time, no pairs of dates and statements."""
    source = Source(t.statements_x, _known(), "date", STATEMENT)
    found = latest_as_of(probes(t), {"statements": source}, ["ticker"], "as_of", k=2)
    rows = found.select(*KEY, F.posexplode("statements").alias("_place", "_s"))
    return rows.select(*KEY, "_s.*", (F.col("_place") + 1).alias("place"))


def latest_statement(t: Tables, rank: int = 1) -> DataFrame:
    return known_statements(t).where(F.col("place") == rank).drop("place")


#: The three statements of a year and what each gives; they are filed, and ranked, apart.
INCOME = ["total_revenue", "gross_profit", "net_income", "ebitda"]
BALANCE = ["total_assets", "total_current_assets", "total_current_liabilities", "long_term_debt", "total_stockholder_equity", "cash"]
CASH_FLOW = ["operating_cash_flow", "free_cash_flow"]


def statement_sources(t: Tables) -> dict[str, Source]:
    """Balance sheets come 20 days after the income statements, those of every third ticker a year late; some years have no cash flow."""
    rows = t.statements_x
    n = F.col("ticker").cast("int") + F.year("date")
    late = rows.withColumn("filing_date", F.date_add(_known(), F.when(n % 3 == 0, 385).otherwise(20)))
    some = rows.where(n % 4 != 0)
    return {"income": Source(rows, _known(), "date", INCOME), "balance": Source(late, "filing_date", "date", BALANCE), "cash_flow": Source(some, _known(), "date", CASH_FLOW)}


def annual_fundamentals(t: Tables, ranks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """as_of, ticker, rank, and the rank-th latest income statement, balance sheet and cash flow, each by its own rank, where all three are known."""
    found = latest_as_of(probes(t), statement_sources(t), ["ticker"], "as_of", k=max(ranks))
    ranked = found.select("*", F.explode(F.array(*[F.lit(r) for r in ranks])).alias("rank"))
    nth = lambda name: F.try_element_at(name, F.col("rank")).alias(name)
    rows = ranked.select(*KEY, "rank", nth("income"), nth("balance"), nth("cash_flow")).where("income is not null and balance is not null and cash_flow is not null")
    dates = [F.col(f"{s}.date").alias(f"{s}_date") for s in ("income", "balance", "cash_flow")]
    values = [F.col(f"{s}.{c}") for s, columns in (("income", INCOME), ("balance", BALANCE), ("cash_flow", CASH_FLOW)) for c in columns]
    return rows.select(*KEY, "rank", *dates, *values)


def _held(t: Tables, rank: int = 1) -> DataFrame:
    return latest_statement(t, rank).join(universe_pit(t), KEY, "left_semi")


def _signal(df: DataFrame, value: Column, digits: int = 6) -> DataFrame:
    return df.select(*KEY, half_up(finite(value), digits).alias("value")).where("value is not null")


def bt_momentum(t: Tables) -> DataFrame:
    """Calendar days: from a year before to a month before."""
    legs = prices_at(t, "recent", t.price_days).join(prices_at(t, "old", t.price_days), KEY)
    return _signal(legs.join(universe_pit(t), KEY), ratio(F.col("recent"), F.col("old")) - 1, 8)


def _sum(*names: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) for n in names])


def _sum_of_scores(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The signal that sums z-scores. The values alone are written first: moments and scores are both of them."""
    narrow = written(df.select(*KEY, *[v.alias(n) for n, v in values.items()]), "scored", even=False)
    return _signal(z_scores(narrow, {n: F.col(n) for n in values}, DATE), _sum(*values))


def bt_quality(t: Tables) -> DataFrame:
    roe = half_up(ratio(F.col("net_income"), F.col("total_stockholder_equity")), 8)
    margin = half_up(ratio(F.col("gross_profit"), F.col("total_revenue")), 8)
    return _sum_of_scores(_held(t), {"z_roe": roe, "z_margin": margin})


@kept
def bt_value(t: Tables) -> DataFrame:
    """Earnings and cash-flow yields and EBITDA to enterprise value; missing debt and cash count as 0."""
    f = _held(t).join(market_cap_asof(t), KEY)
    cap = F.col("market_cap")
    whole = cap + F.coalesce("long_term_debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    yields = {"z_earnings": ratio(F.col("net_income"), cap), "z_cash": ratio(F.col("free_cash_flow"), cap), "z_whole": ratio(F.col("ebitda"), whole)}
    return _sum_of_scores(f, {n: half_up(v, 10) for n, v in yields.items()})


_RATIOS = {
    "roa": ("net_income", "total_assets"),
    "current": ("total_current_assets", "total_current_liabilities"),
    "leverage": ("long_term_debt", "total_assets"),
    "margin": ("gross_profit", "total_revenue"),
    "turnover": ("total_revenue", "total_assets"),
}


@kept
def bt_piotroski(t: Tables) -> DataFrame:
    """Nine tests of this year's statement against last year's; a test with a missing side fails."""
    parts = lambda s: [half_up(ratio(F.col(a), F.col(b)), 8).alias(f"{n}_{s}") for n, (a, b) in _RATIOS.items()]
    now = _held(t).select(*KEY, "operating_cash_flow", "net_income", *parts("now"))
    then = _held(t, 2).select(*KEY, *parts("then"))
    shares = probed_shares(t).withColumnRenamed("shares", "s_now")
    rows = now.join(then, KEY).join(shares, KEY, "left")
    up = lambda n: F.col(f"{n}_now") > F.col(f"{n}_then")
    tests = [
        F.col("roa_now") > 0,
        F.col("operating_cash_flow") > 0,
        up("roa"),
        F.col("operating_cash_flow") > F.col("net_income"),
        F.col("leverage_now") < F.col("leverage_then"),
        up("current"),
        F.col("s_now") <= F.col("s_then"),
        up("margin"),
        up("turnover"),
    ]
    score = reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in tests])
    return rows.select(*KEY, score.cast("double").alias("value"))


def _value_and_score(t: Tables) -> DataFrame:
    return bt_value(t).withColumnRenamed("value", "v").join(bt_piotroski(t).withColumnRenamed("value", "f"), KEY)


def bt_value_piotroski(t: Tables) -> DataFrame:
    return _sum_of_scores(_value_and_score(t), {"z_v": F.col("v"), "z_f": F.col("f")})


SIGNALS = {"momentum": bt_momentum, "quality": bt_quality, "value": bt_value, "piotroski": bt_piotroski, "value_piotroski": bt_value_piotroski}
DISCRETE = {"piotroski"}


def forward_returns(t: Tables) -> DataFrame:
    """Return to the next rebalance less the benchmark's, 0 where that is missing."""
    w = Window.partitionBy("ticker").orderBy("as_of")
    p = prices_asof(t).withColumns({"next_px": F.lead("px").over(w), "next": F.lead("as_of").over(w)})
    p = p.where(F.col("next") == F.last_day(F.add_months("as_of", 1)))
    rows = p.join(benchmark_return(t), "as_of", "left")
    return _signal(rows, ratio(F.col("next_px"), F.col("px")) - 1 - F.coalesce("ret", F.lit(0.0)), 8).withColumnRenamed("value", "fwd")


def signal_values(t: Tables) -> DataFrame:
    """signal, as_of, ticker, value of all signals."""
    return reduce(DataFrame.unionByName, [f(t).select(F.lit(n).alias("signal"), *KEY, "value") for n, f in SIGNALS.items()])


@kept
def cross_sections(t: Tables) -> DataFrame:
    """signal, as_of, ticker, value, fwd (winsorised) of the dates with at least 30 names."""
    by = ["signal", "as_of"]
    rows = written(signal_values(t).join(forward_returns(t), KEY), "returns", even=False)  # counts, percentiles and the result are of one evaluation
    enough = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n >= 30").select(*by)
    return winsorise(rows.join(enough, by), "fwd", by)


def ics(t: Tables) -> DataFrame:
    return rank_correlation(cross_sections(t), "value", "fwd", ["signal", "as_of"])


def ic_decile(t: Tables) -> DataFrame:
    """as_of, bin, n, mean_fwd, ic of the momentum signal."""
    rows = equal_bins(cross_sections(t).where("signal = 'momentum'"), "value", "ticker", DATE)
    mean = F.sum(half_up(F.col("fwd"), 8).cast("decimal(18,8)")).cast("double") / F.count("*")
    bins = rows.groupBy("as_of", "bin").agg(F.count("*").alias("n"), half_up(mean, 6).alias("mean_fwd"))
    by_date = rank_correlation(rows, "value", "fwd", DATE).select("as_of", half_up(F.col("ic"), 6).alias("ic"))
    return bins.join(by_date, "as_of")


def backtest_summary(t: Tables) -> DataFrame:
    """A row for each signal with at least 30 names at some date, keyed by signal throughout."""
    by = ["signal", "as_of"]
    label = F.when(F.col("signal").isin(*DISCRETE), F.round("value").cast("int")).otherwise(F.col("bin"))
    means = equal_bins(cross_sections(t), "value", "ticker", by).withColumn("bin", label).groupBy(*by, "bin").agg(F.avg("fwd").alias("m")).groupBy("signal", "bin").agg(F.avg("m").alias("m"))
    means = written(means, "means")  # so that the shape and the ends are of the same sums
    shape = rank_correlation(means, "bin", "m", ["signal"], least=3).select("signal", F.col("ic").alias("mono"))
    ends = means.groupBy("signal").agg((F.max_by("m", "bin") - F.min_by("m", "bin")).alias("tmb"))
    ic, late = F.col("ic"), F.when(F.col("as_of") >= day(HOLDOUT), F.col("ic"))
    out = ics(t).groupBy("signal").agg(
        F.count("*").alias("n_rebalances"),
        F.avg(ic).alias("m"),
        F.stddev_pop(ic).alias("s"),
        ratio(F.count_if(ic > 0), F.count("*")).alias("hit"),
        F.avg(late).alias("late"),
    )
    none = t.spark.createDataFrame([(s,) for s in SIGNALS], "signal string")
    out = none.join(out, "signal", "left").join(shape, "signal", "left").join(ends, "signal", "left")
    return out.select(
        "signal",
        F.coalesce("n_rebalances", F.lit(0)).alias("n_rebalances"),
        half_up(F.col("m")).alias("mean_ic"),
        half_up(F.when(F.col("s") > 0, F.col("m") / F.col("s"))).alias("ic_ir"),
        half_up(F.col("hit")).alias("ic_hit_rate"),
        half_up(F.col("mono")).alias("monotonicity"),
        half_up(F.col("tmb")).alias("top_minus_bottom"),
        half_up(F.col("late")).alias("holdout_mean_ic"),
        F.lit(True).alias("survivorship_biased"),
    )


def interaction_diagnostic(t: Tables) -> DataFrame:
    """Rank correlation of the F-score with returns in the cheap and the dear half of each date."""
    rows = written(_value_and_score(t).join(forward_returns(t), KEY), "returns", even=False)  # evaluated once, with its broadcasts
    middle = percentiles(rows, ["v"], [0.5], DATE).select("as_of", F.col("percentile").alias("middle"))
    enough = rows.groupBy("as_of").agg(F.count("*").alias("n")).where("n >= 40").select("as_of")
    rows = winsorise(rows.join(middle.join(enough, "as_of"), "as_of"), "fwd", DATE)
    half = rows.withColumn("half", F.when(F.col("v") >= F.col("middle") - 1e-9, "cheap").otherwise("dear"))
    by = rank_correlation(half, "f", "fwd", ["as_of", "half"], least=20)
    return by.select("as_of", "half", "n", half_up(F.col("ic")).alias("ic")).where("ic is not null")


PLANS = {
    f.__name__: f
    for f in (
        rebalance_dates,
        prices_asof,
        shares_asof,
        market_cap_asof,
        benchmark_return,
        universe_pit,
        latest_statement,
        annual_fundamentals,
        bt_momentum,
        bt_quality,
        bt_value,
        bt_piotroski,
        bt_value_piotroski,
        forward_returns,
        ic_decile,
        backtest_summary,
        interaction_diagnostic,
    )
}
