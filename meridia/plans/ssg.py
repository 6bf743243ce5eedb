"""The stock selection guide: focus forecasts, price zones and the buy decision, as column expressions.

Growth is estimated in six ways on each series. Each way is tried on the series without its last one, two and
three values; the way that foretold those best wins. Estimates are array expressions, so a ticker's series stays
one row and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.numbers import half_up, ratio
from meridia.sources.domain import AS_OF, Tables, day, kept

from .strategies import latest_price

# Fixed values of the guide.
HORIZON, MIN_YEARS, MAX_GROWTH, MAX_HIGH_PE = 5, 5, 0.30, 30.0
MIN_ROE, MAX_DEBT, MIN_GROWTH, MIN_UP = 0.15, 0.33, 0.03, 0.6
MIN_RATIO, SMALL, LARGE = 3.0, 1e9, 1e10
RETURNS = {"small": 0.15, "medium": 0.12, "large": 0.07}
BLEND_WITHIN = 0.10


def _compound(s: Column) -> Column:
    """Yearly growth from the first to the last value; null unless both are positive."""
    n, first, last = F.size(s), F.element_at(s, 1), F.element_at(s, -1)
    return F.when((n >= 2) & (first > 0) & (last > 0), F.pow(last / first, 1.0 / (n - 1)) - 1)


def _tail(s: Column, k: int) -> Column:
    return F.when(F.size(s) >= k, F.slice(s, F.greatest(F.size(s) - k + 1, F.lit(1)), F.lit(k))).otherwise(s)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _log_slope(s: Column) -> Column:
    """Least-squares growth of the logarithms; null unless all of three or more values are positive."""
    n = F.size(s)
    logs, places = F.transform(s, lambda v: F.ln(v)), F.transform(s, lambda v, i: i.cast("double"))
    sx, sy = _total(places), _total(logs)
    sxy, sxx = _total(F.zip_with(places, logs, lambda x, y: x * y)), _total(F.transform(places, lambda x: x * x))
    return F.when((n >= 3) & F.forall(s, lambda v: v > 0), F.exp((n * sxy - sx * sy) / (n * sxx - sx * sx)) - 1)


def _steps(s: Column) -> Column:
    """(growth, weight) of each year whose predecessor is positive; later years weigh more."""
    step = lambda i: F.get(s, i - 1) / F.when(F.get(s, i - 2) > 0, F.get(s, i - 2)) - 1
    places = F.sequence(F.lit(2), F.greatest(F.size(s), F.lit(2)))
    pairs = F.transform(places, lambda i: F.struct(step(i).alias("g"), (i - 1).cast("double").alias("w")))
    return F.filter(pairs, lambda p: p["g"].isNotNull())


def _mean_step(s: Column) -> Column:
    steps = _steps(s)
    return F.when(F.size(steps) > 0, _total(F.transform(steps, lambda p: p["g"] * p["w"])) / _total(F.transform(steps, lambda p: p["w"])))


def _last_step(s: Column) -> Column:
    return F.when(F.size(s) >= 2, F.element_at(s, -1) / F.when(F.get(s, F.size(s) - 2) > 0, F.get(s, F.size(s) - 2)) - 1)


#: In order of preference between equals.
ESTIMATORS = {
    "logfit_trend": _log_slope,
    "cagr_5yr": lambda s: _compound(_tail(s, 6)),
    "cagr_3yr": lambda s: _compound(_tail(s, 4)),
    "mean_yoy": _mean_step,
    "cagr_full": _compound,
    "last_yoy": _last_step,
}


def _miss(base: Column, growth: Column, actual: Column) -> Column:
    """Mean symmetric error of the projected values; places where both are 0 do not count."""
    errors = F.transform(actual, lambda a, i: (lambda p: F.when(F.abs(a) + F.abs(p) > 0, F.abs(a - p) / ((F.abs(a) + F.abs(p)) / 2)))(base * F.pow(1 + growth, i + 1)))
    known = F.filter(errors, lambda e: e.isNotNull())
    return F.when(growth.isNotNull() & (F.size(known) > 0), _total(known) / F.size(known))


def focus_forecast(series: DataFrame, keys: list[str], cap: float | None = None, horizon: int = HORIZON) -> DataFrame:
    """keys, method, growth, projected_level, backtest_error from a column `levels` (and `analyst_growth`, if there).

    Nulls in levels do not count; series of fewer than three values give no row.
    """
    if "analyst_growth" not in series.columns:
        series = series.withColumn("analyst_growth", F.lit(None).cast("double"))
    levels = F.filter("levels", lambda v: v.isNotNull())
    rows = series.withColumn("levels", levels).where(F.size("levels") >= 3)
    cut = F.explode(F.sequence(F.lit(0), F.least(F.lit(3), F.size("levels") - 2))).alias("h")
    rows = rows.select(*keys, "levels", "analyst_growth", cut).withColumns({"train": F.slice("levels", F.lit(1), F.size("levels") - F.col("h")), "held": F.slice("levels", F.size("levels") - F.col("h") + 1, F.col("h"))})
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("method"), f(F.col("train")).alias("g")) for k, (n, f) in enumerate(ESTIMATORS.items())])).alias("way")
    tried = rows.select(*keys, "levels", "analyst_growth", "h", "train", "held", ways).select("*", "way.place", "way.method", "way.g")
    tried = tried.withColumn("miss", F.when(F.col("h") > 0, _miss(F.element_at("train", -1), F.col("g"), F.col("held"))))
    full = F.max(F.when((F.col("h") == 0) & (F.abs("g") < float("inf")), F.col("g")))
    by = tried.groupBy(*keys, "place", "method").agg(full.alias("g"), F.avg("miss").alias("err"), F.first("levels").alias("levels"), F.first("analyst_growth").alias("analyst")).where("g is not null")
    best = by.groupBy(*keys).agg(F.min(F.struct(F.col("err").isNull().alias("untried"), half_up(F.col("err"), 12).alias("err"), "place", "method", "g", "levels", "analyst")).alias("b"))
    g, analyst = F.col("b.g"), F.col("b.analyst")
    near = analyst.isNotNull() & (F.abs(analyst - g) <= BLEND_WITHIN)
    growth = F.when(near, 0.5 * g + 0.5 * analyst).otherwise(g)
    growth = growth if cap is None else F.greatest(F.lit(-cap), F.least(growth, F.lit(cap)))
    out = best.select(*keys, F.concat(F.col("b.method"), F.when(near, "+analyst").otherwise("")).alias("method"), growth.alias("growth"), F.element_at("b.levels", -1).alias("last"), F.col("b.err").alias("backtest_error"))
    return out.withColumn("projected_level", F.col("last") * F.pow(1 + F.col("growth"), horizon)).drop("last")


def annual_eps(t: Tables) -> DataFrame:
    """Years with at least three reported quarters."""
    rows = t.earnings_history.where(F.col("eps_actual").isNotNull()).groupBy("ticker", F.year("date").alias("year"))
    return rows.agg(F.sum(F.col("eps_actual").cast("decimal(18,4)")).cast("double").alias("eps"), F.count("*").alias("quarters")).where("quarters >= 3")


def price_extremes(t: Tables) -> DataFrame:
    return t.eod_prices.groupBy("ticker", F.year("date").alias("year")).agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low is not null and high is not null")


def loglinear_growth(t: Tables) -> DataFrame:
    """Growth of yearly EPS by a straight line through its logarithms; two points are enough here."""
    rows = annual_eps(t).where("eps > 0").groupBy("ticker").agg(F.regr_slope(F.ln("eps"), F.col("year").cast("double")).alias("slope"), F.count("*").alias("points"))
    return rows.where("points >= 2").select("ticker", "points", half_up(F.exp("slope") - 1, 5).alias("growth"))


def year_end_close(t: Tables) -> DataFrame:
    return t.eod_prices.groupBy("ticker", F.year("date").alias("year")).agg(F.max_by("close", "date").alias("close"))


def _series(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("year", value))).alias("s")).select("ticker", F.col(f"s.{value}").alias("levels"))


def _last_rows(df: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def study_eps(t: Tables) -> DataFrame:
    """EPS by year, of the years with at least three of the last quarters."""
    quarters = _last_rows(t.growth_earnings.where("eps_actual is not null"), 4 * (MIN_YEARS + 3) + 4)
    total = F.sum(F.col("eps_actual").cast("decimal(18,4)")).cast("double")
    return quarters.groupBy("ticker", F.year("date").alias("year")).agg(total.alias("eps"), F.count("*").alias("quarters")).where("quarters >= 3")


def study_series(t: Tables) -> DataFrame:
    """A row for each ticker: sales by year, EPS of the same years (null if too few), the last year's statement."""
    years = _last_rows(t.growth_statements, MIN_YEARS + 4).withColumn("year", F.year("date"))
    rows = years.join(study_eps(t).select("ticker", "year", "eps"), ["ticker", "year"], "left")
    last = ["income_before_tax", "net_income", "long_term_debt", "short_term_debt", "total_stockholder_equity"]
    by = rows.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("year", "total_revenue", "eps", *last))).alias("s"))
    known = F.array_compact(F.col("s.eps"))
    return by.select(
        "ticker",
        F.size("s").alias("years"),
        F.array_compact(F.col("s.total_revenue")).alias("sales"),
        F.when(F.size(known) >= MIN_YEARS, known).alias("eps"),
        *[F.element_at(f"s.{c}", -1).alias(c) for c in last],
    )


def analyst_growth(t: Tables) -> DataFrame:
    """The estimate of the longest period that has one, as last seen."""
    rank = F.when(F.col("period") == "+5y", 1).when(F.col("period") == "+1y", 2).when(F.col("period") == "0y", 3)
    rows = t.earnings_trend.where("growth is not null").withColumn("rank", rank).where("rank is not null")
    best = F.min(F.struct("rank", (-F.unix_date("date")).alias("age"), "growth")).alias("b")
    return rows.groupBy("ticker").agg(best).select("ticker", F.col("b.growth").alias("analyst_growth"))


def eps_forecast(t: Tables) -> DataFrame:
    series = study_series(t).where("eps is not null").select("ticker", F.col("eps").alias("levels")).join(analyst_growth(t), "ticker", "left")
    return focus_forecast(series, ["ticker"], cap=MAX_GROWTH).select(
        "ticker", "method", half_up(F.col("growth"), 6).alias("growth"), half_up(F.col("projected_level")).alias("projected_level"), half_up(F.col("backtest_error"), 6).alias("backtest_error")
    )


def _mean_without_highest(pe: Column) -> Column:
    """Mean of positive ratios, without the highest when there are five or more."""
    good = F.sort_array(F.filter(pe, lambda v: v > 0))
    kept = F.when(F.size(good) >= 5, F.slice(good, F.lit(1), F.size(good) - 1)).otherwise(good)
    return F.when(F.size(kept) > 0, _total(kept) / F.size(kept))


def pe_history(t: Tables) -> DataFrame:
    """ticker, high_pe (held down), low_pe over the last years of prices."""
    recent = t.eod_prices.where((F.col("date") >= F.date_sub(day(AS_OF), 365 * (MIN_YEARS + 1))) & F.col("low").isNotNull() & F.col("high").isNotNull())
    extremes = recent.groupBy("ticker", F.year("date").alias("year")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    pe = extremes.join(study_eps(t).where("eps > 0"), ["ticker", "year"])
    by = pe.groupBy("ticker").agg(F.collect_list(F.col("high") / F.col("eps")).alias("his"), F.collect_list(F.col("low") / F.col("eps")).alias("los"))
    return by.select("ticker", F.least(F.lit(MAX_HIGH_PE), _mean_without_highest(F.col("his"))).alias("high_pe"), _mean_without_highest(F.col("los")).alias("low_pe"))


def study_history(t: Tables) -> DataFrame:
    """Growth, returns on equity, margin and debt of each ticker, and what keeps it from passing the quality gates."""
    header = t.fundamentals.select("ticker", "market_cap", "dividend_yield", "return_on_equity")
    rows = study_series(t).join(header, "ticker", "left")
    # a growth of exactly 0 counts as unknown and falls back to the endpoints
    grown = lambda s: F.coalesce(F.nullif(_log_slope(F.col(s)), F.lit(0.0)), _compound(F.col(s)))
    rises = F.filter(F.transform("sales", lambda v, i: (i > 0) & (v > F.get("sales", i - 1))), lambda up: up)
    debt, equity = F.coalesce("long_term_debt", F.lit(0.0)) + F.coalesce("short_term_debt", F.lit(0.0)), F.col("total_stockholder_equity")
    filed_roe = F.when((equity > 0) & (F.col("net_income") != 0), F.col("net_income") / equity)
    rows = rows.withColumns(
        {
            "sales_growth": grown("sales"),
            "eps_growth": grown("eps"),
            "up_fraction": F.size(rises) / F.greatest(F.size("sales") - 1, F.lit(1)),
            "roe": F.coalesce("return_on_equity", filed_roe),
            "debt_to_cap": F.when((equity != 0) & (debt + equity > 0), debt / (debt + equity)),
            "margin": ratio(F.col("income_before_tax"), F.element_at("sales", -1)),
        }
    )
    bad = lambda c, least: F.col(c).isNull() | (F.col(c) < least)
    gates = F.array(
        F.when(bad("sales_growth", MIN_GROWTH), "sales growth too low"),
        F.when(bad("eps_growth", MIN_GROWTH), "EPS growth too low"),
        F.when(F.col("up_fraction") < MIN_UP, "inconsistent sales"),
        F.when(bad("roe", MIN_ROE), "ROE too low"),
        F.when(F.col("debt_to_cap") > MAX_DEBT, "too much debt"),
        F.when(F.col("margin") <= 0, "no margin"),
    )
    few = F.col("years") < MIN_YEARS
    rows = rows.withColumn("gates", F.when(few, F.array(F.lit("too few years"))).otherwise(F.array_compact(gates)))
    return rows.withColumn("quality_pass", F.size("gates") == 0)


def study_forecast(t: Tables) -> DataFrame:
    """The rows of study_history; for those that pass also growth to come, prices, zones, ratio and returns."""
    history = study_history(t)
    passed = F.col("quality_pass")
    sales = focus_forecast(history.where(passed).select("ticker", F.col("sales").alias("levels")), ["ticker"], cap=MAX_GROWTH)
    eps = history.where(passed & F.col("eps").isNotNull()).select("ticker", F.col("eps").alias("levels")).join(analyst_growth(t), "ticker", "left")
    eps = focus_forecast(eps, ["ticker"], cap=MAX_GROWTH)
    rows = history.join(sales.select("ticker", F.col("growth").alias("fc_sales")), "ticker", "left")
    rows = rows.join(eps.select("ticker", F.col("growth").alias("fc_alone"), F.col("method").alias("eps_method")), "ticker", "left")
    price = latest_price(t).select("ticker", F.col("price").alias("cur"))
    rows = rows.join(pe_history(t), "ticker", "left").join(price, "ticker", "left")
    # earnings do not outgrow sales
    rows = rows.withColumns({"fc_eps": F.least("fc_alone", F.coalesce("fc_sales", "fc_alone")), "base": F.element_at("eps", -1)})
    rows = rows.withColumn("projected", F.when(F.col("base") != 0, F.col("base") * F.pow(1 + F.col("fc_eps"), HORIZON)))
    whole = (F.col("projected") != 0) & (F.col("high_pe") != 0) & (F.col("low_pe") != 0) & (F.col("base") != 0) & (F.col("cur") != 0)
    rows = rows.withColumns({"hi": F.when(whole, F.col("high_pe") * F.col("projected")), "lo": F.when(whole, F.col("low_pe") * F.col("base"))})
    third = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 3)
    rows = rows.withColumns({"buy_below": F.col("lo") + third, "sell_above": F.col("hi") - third})
    down, up, priced = F.col("cur") - F.col("lo"), F.col("hi") - F.col("cur"), third.isNotNull()
    appreciation = F.when(priced & (F.col("cur") > 0) & (F.col("hi") > 0), F.pow(F.col("hi") / F.col("cur"), 1 / HORIZON) - 1)
    return rows.withColumns(
        {
            "zone": F.when(F.col("cur") <= F.col("buy_below"), "BUY").when(F.col("cur") >= F.col("sell_above"), "SELL").when(priced, "HOLD"),
            "updown": F.when(priced & (down > 0), up / down).when(priced & (up > 0), float("inf")),
            "appreciation": appreciation,
            "total_return": F.when(priced, F.coalesce(appreciation, F.lit(0.0)) + F.coalesce("dividend_yield", F.lit(0.0))),
        }
    )


def ssg_study(t: Tables) -> DataFrame:
    """A row for each ticker: growth, quality gates, forecast prices, zone, ratio, return, decision, and the reasons for it."""
    rows = study_forecast(t)
    cap, passed = F.col("market_cap"), F.col("quality_pass")
    hurdle = F.when(cap < SMALL, RETURNS["small"]).when(cap >= LARGE, RETURNS["large"]).otherwise(RETURNS["medium"])
    open_ = passed & (F.col("zone").isNull() | F.col("updown").isNull())
    against = F.array(
        F.when(open_, "price zones unavailable"),
        F.when(passed & ~open_ & (F.col("zone") != "BUY"), "not in the buy zone"),
        F.when(passed & ~open_ & (F.col("updown") < MIN_RATIO), "too little to gain for what can be lost"),
        F.when(passed & ~open_ & (F.col("total_return") < hurdle), "return below the hurdle"),
    )
    reasons = F.concat("gates", F.array_compact(against))
    if_passed = {
        "zone": F.col("zone"),
        "updown_ratio": half_up(F.when(F.col("updown") < float("inf"), F.col("updown"))),
        "forecast_growth": half_up(F.col("fc_eps")),
        "projected_eps_5yr": half_up(F.col("projected")),
        **{c: half_up(F.col(c)) for c in ("high_pe", "low_pe", "buy_below", "sell_above", "total_return")},
        "price_appreciation_cagr": half_up(F.col("appreciation")),
        "eps_method": F.col("eps_method"),
    }
    return rows.select(
        day(AS_OF).alias("issue_date"),
        "ticker",
        F.col("cur").alias("current_price"),
        (F.size(reasons) == 0).alias("is_buy"),
        "quality_pass",
        *[half_up(F.col(c)).alias(c) for c in ("sales_growth", "eps_growth", "roe", "debt_to_cap")],
        *[F.when(passed, v).alias(n) for n, v in if_passed.items()],
        F.array_join(reasons, "; ").alias("reasons"),
    )


def pe_ratios(t: Tables) -> DataFrame:
    return pe_history(t).select("ticker", half_up(F.col("high_pe"), 6).alias("high_pe"), half_up(F.col("low_pe"), 6).alias("low_pe"))


PLANS = {f.__name__: f for f in (annual_eps, price_extremes, loglinear_growth, year_end_close, analyst_growth, pe_ratios, eps_forecast, ssg_study)}
