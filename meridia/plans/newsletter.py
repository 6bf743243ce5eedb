"""The sections of the daily findings document: facts are computed here, prose only narrates them.

Each section gives typed facts with a rank; findings() turns all of them into rows (section, rank, ticker,
headline, facts as JSON), payload() into one JSON document by section.
"""

from __future__ import annotations

from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.numbers import half_up, money, pct_change
from meridia.operators.ordered import percentiles
from meridia.operators.latest import as_of_join, latest_by
from meridia.sources.domain import AS_OF, BENCHMARKS, CONFIG, EARNINGS_DAY, EVENTS_AS_OF, Tables, day

from . import flows, strategies

TOP, MOVERS = CONFIG["top_n"], CONFIG["top_n_movers"]


def _ranked(df: DataFrame, *order: Column, limit: int | None = None, key: str = "ticker") -> DataFrame:
    """Sorted, cut, then numbered: the number is given to a section's few rows only."""
    cut = df.orderBy(*order, key).limit(limit) if limit else df
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*order, key)))


def _named(df: DataFrame, t: Tables, *columns: str) -> DataFrame:
    return df.join(t.fundamentals.select("ticker", *columns), "ticker", "left")


def _liquid(t: Tables) -> DataFrame:
    return flows.price_perf(t).where((F.col("close") >= CONFIG["min_price"]) & (F.col("avg_vol_20d") >= CONFIG["min_avg_vol_20d"]))


def provenance(t: Tables) -> DataFrame:
    price = flows.price_perf(t).agg(F.max("as_of").alias("price_as_of"), F.count("*").alias("universe_size"))
    held = flows.inst_flow_ticker(t).agg(F.max("latest_filing").alias("institutional_as_of"), F.count("*").alias("holders_universe_size"))
    ratings = t.analyst_ratings.agg(F.count("*").alias("analyst_ratings_rows"))
    rows = price.crossJoin(held).crossJoin(ratings)  # one row each
    lag = F.datediff(day(AS_OF), F.col("institutional_as_of"))
    return rows.select(F.lit(1).alias("rank"), "*", lag.alias("institutional_lag_days"))


def market_breadth(t: Tables) -> DataFrame:
    """Counts and medians of all liquid names; the medians come from counts by range, so no task sorts the market."""
    liquid = _liquid(t).where("ret_1d is not null")
    up, down = F.count_if(F.col("ret_1d") > 0), F.count_if(F.col("ret_1d") < 0)
    known = F.count("ret_12m")
    counts = liquid.agg(
        F.count("*").alias("total"),
        up.alias("advancers"),
        down.alias("decliners"),
        F.count_if(F.col("ret_1d") == 0).alias("unchanged"),
        F.when(down > 0, half_up(up / down, 2)).alias("advance_decline_ratio"),
        F.when(known > 0, half_up(100.0 * F.count_if(F.col("ret_12m") > 0) / known, 1)).alias("pct_above_zero_12m"),
    ).where("total > 0")
    columns = ["ret_1d", "ret_5d", "ret_1m"]
    of = lambda c: half_up(F.max(F.when(F.col("value") == c, F.col("percentile"))), 2).alias(f"median_{c}")
    medians = percentiles(liquid, columns, [0.5]).agg(*[of(c) for c in columns])
    return counts.crossJoin(medians)  # one row each


_MOVE = ["ticker", "as_of", "close", "ret_1d", "ret_5d", "ret_1m", "ret_3m", "ret_12m", "volume", "avg_vol_20d", "vol_ratio", "name", "sector", "market_cap"]


def _movers(t: Tables, up: bool) -> DataFrame:
    rows = _named(_liquid(t).where(F.col("ret_1d") > 0 if up else F.col("ret_1d") < 0), t, "name", "sector", "market_cap")
    ranked = _ranked(rows, F.desc("ret_1d") if up else F.asc("ret_1d"), limit=TOP)
    return ranked.select("rank", *_MOVE)


def movers_up(t: Tables) -> DataFrame:
    return _movers(t, True)


def movers_down(t: Tables) -> DataFrame:
    return _movers(t, False)


def _active(t: Tables, up: bool) -> DataFrame:
    rows = _named(_liquid(t).where(F.col("ret_1d") > 0 if up else F.col("ret_1d") < 0), t, "name", "sector", "is_delisted").where(~F.coalesce("is_delisted", F.lit(False)))
    ranked = _ranked(rows, F.desc("ret_1d") if up else F.asc("ret_1d"), F.desc("volume"), limit=MOVERS)
    dollars = F.floor(F.col("close") * F.col("volume") + 0.5).cast("double")
    return ranked.select("rank", "ticker", "name", "sector", "as_of", "close", "ret_1d", "ret_5d", "volume", "avg_vol_20d", "vol_ratio", dollars.alias("dollar_volume"))


def movers_advancing(t: Tables) -> DataFrame:
    return _active(t, True)


def movers_declining(t: Tables) -> DataFrame:
    return _active(t, False)


def _top_holders(t: Tables, tickers: DataFrame, keep: Column, order: Column, *columns: str) -> DataFrame:
    """ticker, holders: up to three of each ticker's rows, as one string in order."""
    flow = flows.inst_flow(t).join(tickers.select("ticker", F.col("latest_filing").alias("_latest")), "ticker").where(keep)
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(order, "holder_name"))
    text = F.concat_ws("|", "holder_name", *[F.format_string("%.4f", c) if c.startswith("pct") else F.format_string("%.0f", c) for c in columns])
    top = flow.withColumn("_place", place).where("_place <= 3").groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("_place", text.alias("text")))).alias("_top"))
    return top.select("ticker", F.array_join("_top.text", ";").alias("holders"))


def _rankable(t: Tables) -> DataFrame:
    floors = (F.col("top_n_holders") >= CONFIG["min_holders"]) & (F.col("holders_at_latest") >= CONFIG["min_holders_at_latest"]) & (F.col("prior_shares_at_latest") >= CONFIG["min_prior_shares"])
    return flows.inst_flow_ticker(t).where(F.col("net_change_pct").isNotNull() & floors)


def _institutions(t: Tables, building: bool) -> DataFrame:
    top = _ranked(_rankable(t), F.desc("net_change_pct") if building else F.asc("net_change_pct"), limit=TOP)
    actions = ("added", "initiated") if building else ("trimmed",)
    now = (F.col("report_date") == F.col("_latest")) & F.col("action").isin(*actions)
    holders = _top_holders(t, top, now, F.desc("change_shares") if building else F.asc("change_shares"), "change_shares", "shares_held", "pct_assets")
    perf = flows.price_perf(t).select("ticker", "ret_3m", "ret_12m")
    columns = ["rank", "ticker", "name", "sector", "latest_filing", "holders_at_latest", "holders_lagging", "net_change_shares", "net_change_pct", "prior_shares_at_latest", "top_n_holders", "top_n_at_cap", "n_added", "n_trimmed", "n_initiated", "n_unchanged", "ret_3m", "ret_12m", "holders"]
    return _named(top, t, "name", "sector").join(perf, "ticker", "left").join(holders, "ticker", "left").select(*columns)


def inst_accumulation(t: Tables) -> DataFrame:
    return _institutions(t, True)


def inst_distribution(t: Tables) -> DataFrame:
    return _institutions(t, False)


def inst_ownership(t: Tables) -> DataFrame:
    rows = flows.inst_flow_ticker(t).where(F.col("max_holder_conviction_pct").isNotNull() & (F.col("top_n_holders") >= CONFIG["min_holders"]))
    top = _ranked(rows, F.desc("max_holder_conviction_pct"), limit=TOP)
    holders = _top_holders(t, top, F.col("pct_assets").isNotNull(), F.desc("pct_assets"), "pct_assets", "pct_shares", "shares_held")
    return _named(top, t, "name", "sector").join(holders, "ticker", "left").select("rank", "ticker", "name", "sector", "latest_filing", "top_n_holders", "top_n_pct_of_shares_out", "largest_holder_pct", "max_holder_conviction_pct", "top_n_at_cap", "holders")


def fund_flow_notable(t: Tables) -> DataFrame:
    floors = (F.col("top_n_funds") >= CONFIG["min_holders"]) & (F.col("funds_in_window") >= 3) & (F.col("prior_shares_in_window") >= CONFIG["min_prior_shares"])
    top = _ranked(flows.fund_flow_ticker(t).where(F.col("net_change_pct").isNotNull() & floors), F.desc(F.abs("net_change_pct")), limit=TOP)
    return _named(top, t, "name", "sector").select("rank", "ticker", "name", "sector", "latest_filing", "window_earliest_filing", "filing_span_days", "top_n_funds", "funds_in_window", "funds_stale", "net_change_shares", "net_change_pct", "prior_shares_in_window", "n_initiated", "n_added", "n_trimmed")


def insider_activity(t: Tables) -> DataFrame:
    """Open-market codes only."""
    rows = t.insider_transactions.where(F.col("transaction_code").isin("P", "S") & (F.col("transaction_date") >= F.date_sub(day(EVENTS_AS_OF), 30)) & F.col("value").isNotNull())
    value = lambda c: F.coalesce(F.sum(F.when(F.col("transaction_code") == c, F.col("value").cast("decimal(18,2)"))).cast("double"), F.lit(0.0))
    agg = rows.groupBy("ticker").agg(
        F.count("*").alias("n_txns"), F.count_if(F.col("transaction_code") == "P").alias("n_buys"), F.count_if(F.col("transaction_code") == "S").alias("n_sells"), F.count_distinct("owner_name").alias("n_insiders"),
        value("P").alias("buy_value"), value("S").alias("sell_value"), F.min("transaction_date").alias("earliest"), F.max("transaction_date").alias("latest"),
    ).where("n_txns >= 2")
    agg = agg.withColumn("net_value", half_up(F.col("buy_value") - F.col("sell_value"), 2))
    return _named(_ranked(agg, F.desc(F.abs("net_value")), limit=TOP), t, "name", "sector")


def analyst_consensus(t: Tables) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    rows = t.analyst_ratings.where("rating is not null").withColumns({"place": F.row_number().over(w), "prev_date": F.lead("date").over(w), "prev_rating": F.lead("rating").over(w), "prev_target_price": F.lead("target_price").over(w)})
    drift = half_up(F.col("rating") - F.col("prev_rating"))
    rows = rows.where("place = 1 and prev_date is not null").withColumn("drift", drift).where(F.abs("drift") >= 0.05)
    top = _named(_ranked(rows, F.desc(F.abs("drift")), limit=TOP), t, "name", "sector").join(flows.price_perf(t).select("ticker", "close"), "ticker", "left")
    return top.select(
        "rank", "ticker", "name", "sector", F.col("date").alias("curr_date"), "prev_date", F.col("rating").alias("curr_rating"), "prev_rating", "drift", F.col("target_price").alias("curr_target_price"), "prev_target_price",
        "close", pct_change(F.col("target_price"), F.col("close")).alias("target_vs_close_pct"), "strong_buy", "buy", "hold", "sell", "strong_sell",
    )


def holiday_payloads(t: Tables) -> DataFrame:
    """The calendar of an exchange as JSON text: a day for each nation, five days apart, under spellings that vary; some have no date."""
    n = F.col("n_nationkey")
    name, date = F.concat(F.lit("Day of "), F.initcap("n_name")), F.date_add(day("2001-06-20"), (n * 5).cast("int")).cast("string")
    given = F.when(n % 7 == 6, F.lit("")).otherwise(date)
    entry = (
        F.when(n % 3 == 0, F.to_json(F.struct(name.alias("Holiday"), given.alias("Date"), F.lit("official").alias("Type"))))
        .when(n % 3 == 1, F.to_json(F.struct(name.alias("Name"), given.alias("date"))))
        .otherwise(F.to_json(F.struct(name.alias("holiday"), given.alias("Date"), F.lit("bank").alias("type"))))
    )
    entries = F.sort_array(F.collect_list(F.concat(F.lit('"'), n.cast("string"), F.lit('":'), entry)))
    return t.read("nation").agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("holidays"))


def market_holidays(t: Tables) -> DataFrame:
    """Today's closure and the nearest one after it, from a JSON map whose key spellings vary."""
    entries = holiday_payloads(t).select(F.explode(F.from_json("holidays", "map<string,map<string,string>>")).alias("key", "v"))
    value = lambda *names: F.coalesce(*[F.col("v")[n] for n in names])
    h = entries.select(F.coalesce(value("Holiday", "Name", "holiday"), F.col("key")).alias("name"), value("Type", "type").alias("type"), F.to_date(F.nullif(value("Date", "date"), F.lit(""))).alias("date"))
    nearest = h.where(F.col("date") > day(AS_OF)).agg(F.min("date").alias("nearest"))
    rows = h.crossJoin(nearest).where((F.col("date") == day(AS_OF)) | (F.col("date") == F.col("nearest"))).drop("nearest")
    away = F.datediff("date", day(AS_OF))
    return rows.select(F.row_number().over(Window.orderBy("date", "name")).alias("rank"), "name", "type", "date", (F.col("date") == day(AS_OF)).alias("is_today"), away.alias("days_away"))


def earnings_reports(t: Tables) -> DataFrame:
    rows = _named(t.earnings_history.where(F.col("report_date") == day(EARNINGS_DAY)), t, "name", "sector", "market_cap").withColumn("size", F.coalesce("market_cap", F.lit(0.0)))
    ranked = _ranked(rows, F.desc("size"), limit=2 * TOP)
    status = F.when(F.col("eps_actual").isNotNull(), "reported").otherwise("scheduled")
    difference = half_up(F.col("eps_actual") - F.col("eps_estimate")).alias("eps_difference")
    return ranked.select(
        "rank", "ticker", "name", "sector", "market_cap", "report_date", "eps_actual", "eps_estimate", difference, "surprise_pct", status.alias("status")
    )


def index_overview(t: Tables) -> DataFrame:
    """Returns of the benchmarks over calendar days on raw closes: five as-of lookups in one pass over their own prices."""
    mark = [F.struct(F.lit(a).alias("ticker"), F.lit(b).alias("display_name"), F.lit(c).alias("sort_order")) for a, b, c in BENCHMARKS]
    marks = F.broadcast(t.spark.range(0, 1, 1, 1).select(F.inline(F.array(*mark))))  # the configured few, without a Python worker a core
    prices = t.eod_prices.where("close > 0").join(marks.select("ticker"), "ticker", "left_semi")
    last = latest_by(prices, ["ticker"], ["date"], ["close"]).select("ticker", F.col("date").alias("as_of"), "close")
    legs = {"1d": F.date_sub("as_of", 1), "5d": F.date_sub("as_of", 7), "1m": F.date_sub("as_of", 31), "ytd": F.date_sub(F.trunc("as_of", "YEAR"), 1), "12m": F.date_sub("as_of", 365)}
    probes = last.select("ticker", F.explode(F.array(*[F.struct(F.lit(n).alias("leg"), d.alias("at")) for n, d in legs.items()])).alias("p")).select("ticker", "p.leg", "p.at")
    found = as_of_join(probes, prices, ["ticker"], "at", "date", {"then": "close"}).groupBy("ticker").agg(*[F.max(F.when(F.col("leg") == n, F.col("then"))).alias(f"c_{n}") for n in legs])
    rows = last.join(found, "ticker").join(marks, "ticker")
    return rows.select((F.col("sort_order") / 10).cast("int").alias("rank"), "ticker", "display_name", "as_of", "close", *[half_up((F.col("close") / F.col(f"c_{n}") - 1) * 100.0, 2).alias(f"ret_{n}") for n in legs])


def _verdict_ranked(picks: DataFrame, *order: Column) -> DataFrame:
    """Rank in each bucket and over all, buy before hold before sell."""
    priority = F.when(F.col("verdict") == "buy", 1).when(F.col("verdict") == "hold", 2).otherwise(3)
    rows = picks.withColumns({"vpri": priority, "bucket_rank": F.row_number().over(Window.partitionBy("verdict").orderBy(*order, "ticker"))})
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("vpri", *order, "ticker"))).where(F.col("bucket_rank") <= 2 * TOP).drop("vpri", "bucket_rank")


def strategy_picks(t: Tables, signals: DataFrame | None = None) -> DataFrame:
    """Names that a run of the strategies flagged, by analyst consensus; without coverage they are held."""
    signals = strategies.strategy_signals(t) if signals is None else signals
    rating = latest_by(t.analyst_ratings.where("rating is not null"), ["ticker"], ["date"], ["rating", "target_price", "strong_buy", "buy", "hold", "sell", "strong_sell"]).drop("date")
    rows = signals.join(rating, "ticker", "left").join(flows.price_perf(t).select("ticker", "close", "ret_1d", "ret_3m", "ret_12m"), "ticker", "left")
    verdict = F.when(F.col("rating").isNull(), "hold").when(F.col("rating") >= 3.5, "buy").when(F.col("rating") >= 2.5, "hold").otherwise("sell")
    n = sum((F.coalesce(c, F.lit(0)) for c in ("strong_buy", "buy", "hold", "sell", "strong_sell")), F.lit(0))
    picks = _named(rows, t, "name", "sector").withColumns({"verdict": verdict, "rated": F.col("rating").isNotNull(), "n_ratings": n, "target_vs_close_pct": pct_change(F.col("target_price"), F.col("close"))})
    return _verdict_ranked(picks, F.desc("is_top_conviction"), F.coalesce("conviction_rank", F.lit(2147483647)), F.desc("signal_count"))


def drawn_picks(t: Tables) -> DataFrame:
    """The picks of the persisted run with drawn parameters."""
    return strategy_picks(t, strategies.drawn_signals(t))


def news_recap(t: Tables) -> DataFrame:
    """The latest story of each title within 36 hours; no upper bound in time."""
    recent = t.news.where((F.col("published_at") >= F.lit(EVENTS_AS_OF).cast("timestamp") - F.expr("INTERVAL 36 HOURS")) & F.col("title").isNotNull())
    story = latest_by(recent, ["title"], ["published_at", "event_id"], ["ticker", "sentiment_polarity", "symbols"])
    tone = F.when(F.col("sentiment_polarity") >= 0.15, "positive").when(F.col("sentiment_polarity") <= -0.15, "negative").otherwise("neutral")
    return _ranked(story, F.desc("published_at"), limit=2 * TOP, key="title").select("rank", "title", "ticker", "published_at", "sentiment_polarity", F.array_join("symbols", ",").alias("symbols"), tone.alias("tone"))


def sector_heatmap(t: Tables) -> DataFrame:
    rows = _liquid(t).where("ret_1d is not null").join(t.fundamentals.where("sector is not null and market_cap > 0 and not coalesce(is_delisted, false)").select("ticker", "sector", "market_cap"), "ticker")
    ret, cap = F.col("ret_1d").cast("decimal(10,2)"), F.col("market_cap").cast("decimal(20,2)")
    agg = rows.groupBy("sector").agg(
        half_up(F.sum(ret * cap).cast("double") / F.sum(cap).cast("double"), 2).alias("weighted_ret_1d"), half_up(F.sum(ret).cast("double") / F.count("*"), 2).alias("avg_ret_1d"), F.count("*").alias("n"),
        F.count_if(F.col("ret_1d") > 0).alias("n_advancing"), F.count_if(F.col("ret_1d") < 0).alias("n_declining"), F.sum(cap).cast("double").alias("total_market_cap"),
    )
    return _ranked(agg, F.desc_nulls_last("weighted_ret_1d"), key="sector")


def ssg_picks(t: Tables) -> DataFrame:
    """Screened names by verdict of the study."""
    from .ssg import ssg_study

    g = ssg_study(t).where("quality_pass")
    verdict = F.when(F.col("is_buy"), "buy").when(F.col("zone") == "SELL", "sell").otherwise("hold")
    return _verdict_ranked(_named(g.withColumn("verdict", verdict), t, "name", "sector"), F.desc_nulls_last("total_return"))


SECTIONS = {
    f.__name__: f
    for f in (
        provenance, market_breadth, movers_up, movers_down, inst_accumulation, inst_distribution, inst_ownership, fund_flow_notable, insider_activity, analyst_consensus,
        market_holidays, earnings_reports, index_overview, strategy_picks, ssg_picks, news_recap, movers_advancing, movers_declining, sector_heatmap,
    )
}


#: What a section says when nothing was run for it.
NO_RUN = {"strategy_picks": "No run of the strategies to go by.", "ssg_picks": "No stock study to go by."}

#: Headlines by section: the first whose condition holds. In braces a column, then how it is shown: as text, with two
#: digits, or as money; who is the name and the ticker. Conditions are plain SQL, so the same text serves another engine.
HEADLINES: dict[str, list[tuple[str, str]]] = {
    "provenance": [("true", "Prices to {price_as_of:s}, filings to {institutional_as_of:s}, which is {institutional_lag_days:s} days back.")],
    "market_breadth": [("true", "{advancers:s} of {total:s} liquid names rose and {decliners:s} fell; half of them moved by more than {median_ret_1d:2}%.")],
    "movers_up": [("true", "{who} gained {ret_1d:2}% in a day; volume was {vol_ratio:2} times its mean.")],
    "movers_down": [("true", "{who} lost ground, {ret_1d:2}% in a day; volume was {vol_ratio:2} times its mean.")],
    "inst_accumulation": [("true", "{who}: large holders reported {net_change_pct:2}% more shares at {latest_filing:s}; {n_added:s} bought more, {n_initiated:s} are new.")],
    "inst_distribution": [("true", "{who}: holdings of large holders changed by {net_change_pct:2}% at {latest_filing:s}; {n_trimmed:s} sold, {n_added:s} bought more.")],
    "inst_ownership": [("true", "{who}: the first of {top_n_holders:s} holders has {largest_holder_pct:2}% of the shares; for one they are {max_holder_conviction_pct:2}% of its book.")],
    "fund_flow_notable": [("true", "{who}: shares held by funds changed by {net_change_pct:2}%, by {funds_in_window:s} filings since {window_earliest_filing:s}.")],
    "insider_activity": [
        ("net_value < 0", "{who}: {n_insiders:s} insiders sold more than they bought in {n_txns:s} trades, net {net_value:money}."),
        ("true", "{who}: {n_insiders:s} insiders bought as much as they sold or more in {n_txns:s} trades, net {net_value:money}."),
    ],
    "analyst_consensus": [("true", "{who}: the mean rating went from {prev_rating:2} to {curr_rating:2} of 5 after {prev_date:s}.")],
    "market_holidays": [("is_today", "Markets rest today: {name:s}."), ("true", "Markets rest next on {date:s}, in {days_away:s} days: {name:s}.")],
    "earnings_reports": [
        ("eps_actual IS NULL", "{who} reports on {report_date:s}; {eps_estimate:2} a share is expected."),
        ("eps_estimate IS NULL", "{who} earned {eps_actual:2} a share; no estimate was known."),
        ("true", "{who} earned {eps_actual:2} a share where {eps_estimate:2} was expected."),
    ],
    "index_overview": [("true", "{display_name:s}: {ret_1d:2}% in a day, {ret_1m:2}% in a month, {ret_ytd:2}% this year.")],
    "strategy_picks": [
        ("NOT rated", "{who}: hold, as no analyst covers it; {signal_count:s} strategies name it."),
        ("true", "{who}: {verdict:s} by a rating of {rating:2} from {n_ratings:s} analysts; {signal_count:s} strategies name it."),
    ],
    "ssg_picks": [
        ("verdict = 'buy'", "{who}: worth buying below {buy_below:2}, now {current_price:2}; {updown_ratio:2} to gain for 1 to lose."),
        ("verdict = 'sell'", "{who}: at {current_price:2} above the {sell_above:2} where selling begins."),
        ("true", "{who}: good enough to hold; a return of {total_return:2} a year is foreseen."),
    ],
    "news_recap": [("true", "{title:s}")],
    "movers_advancing": [("true", "{who}: {ret_1d:2}% up on {volume:s} shares.")],
    "movers_declining": [("true", "{who}: {ret_1d:2}% on {volume:s} shares.")],
    "sector_heatmap": [("true", "{sector:s}: {weighted_ret_1d:2}% by market value; {n_advancing:s} of {n:s} names up, {n_declining:s} down.")],
}


def headline_parts(template: str) -> list[tuple[str, str, str]]:
    """(text, column, how) in order; text comes before the column, which may be empty."""
    return [(text, field or "", how or "s") for text, field, how, _ in Formatter().parse(template)]


def headline(section: str) -> Column:
    def shown(field: str, how: str) -> Column:
        if field == "who":
            return F.concat(F.coalesce("name", "ticker"), F.lit(" ("), "ticker", F.lit(")"))
        text = {"s": F.col(field).cast("string"), "2": F.format_string("%.2f", half_up(F.col(field).cast("double"), 2)), "money": money(F.col(field))}[how]
        return F.when(F.col(field).isNull(), "n/a").otherwise(text)

    out = None
    for condition, template in HEADLINES[section]:
        parts = [p for text, field, how in headline_parts(template) for p in (F.lit(text), *([shown(field, how)] if field else []))]
        out = F.when(F.expr(condition), F.concat(*parts)) if out is None else out.when(F.expr(condition), F.concat(*parts))
    return out


def findings(t: Tables, sections: dict | None = None) -> DataFrame:
    """issue_date, section, rank, ticker, headline, facts (JSON) of all sections.

    A section without rows leaves none, but for those that classify a run: they say that there was none.
    """
    rows = []
    for name, f in (sections or SECTIONS).items():
        df = f(t)
        have = set(df.columns)
        rank = (F.col("rank") if "rank" in have else F.lit(1)).cast("int").alias("rank")
        ticker = (F.col("ticker") if "ticker" in have else F.lit(None).cast("string")).alias("ticker")
        facts = F.to_json(F.struct(*[c for c in df.columns if c != "rank"])).alias("facts")
        one = df.select(day(AS_OF).alias("issue_date"), F.lit(name).alias("section"), rank, ticker, headline(name).alias("headline"), facts)
        if name in NO_RUN:
            note = t.spark.range(1).join(df.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")
            status = F.to_json(F.struct(F.lit("no_run").alias("status"))).alias("facts")
            note = note.select(day(AS_OF).alias("issue_date"), F.lit(name).alias("section"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("ticker"), F.lit(NO_RUN[name]).alias("headline"), status)
            one = one.unionByName(note)
        rows.append(one)
    return reduce(DataFrame.unionByName, rows)


def newsletter_payload(t: Tables) -> DataFrame:
    """One JSON document: a list of items in rank order for each section."""
    item = F.struct("rank", "headline", "facts")
    by = findings(t).groupBy("issue_date", "section").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return by.groupBy("issue_date").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "items"))))).alias("payload"))


def newsletter_findings(t: Tables) -> DataFrame:
    """issue_date, section, rank, ticker, headline, as the document has them."""
    opened = F.from_json("payload", "map<string,array<struct<rank:int,headline:string,facts:string>>>")
    rows = newsletter_payload(t).select("issue_date", F.explode(opened).alias("section", "items")).select("issue_date", "section", F.explode("items").alias("i"))
    return rows.select("issue_date", "section", "i.rank", F.get_json_object("i.facts", "$.ticker").alias("ticker"), "i.headline")
