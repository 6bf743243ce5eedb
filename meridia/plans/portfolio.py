"""Positions, summaries and the equity curve of portfolios, and chart overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.numbers import half_up, ratio
from meridia.operators.frames import in_blocks
from meridia.operators.latest import as_of_join
from meridia.operators.upsert import coalescing_upsert
from meridia.sources.domain import Tables

from .strategies import latest_price


def _signed(buy: Column, sell: Column) -> Column:
    return F.when(F.col("side") == "BUY", buy).otherwise(sell)


def valid_trades(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades that can be booked, with their side in capitals, and the others with a reason."""
    side = F.upper("side")
    reason = (
        F.when(~F.coalesce(side.isin("BUY", "SELL"), F.lit(False)), "side must be BUY or SELL")
        .when(F.col("ticker").isNull() | (F.col("ticker") == ""), "no ticker")
        .when(F.col("trade_date").isNull(), "no date")
        .when(F.col("quantity").isNull() | F.col("price").isNull(), "no quantity or price")
    )
    judged = trades.withColumns({"side": side, "reason": reason})
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def change_trades(trades: DataFrame, changes: DataFrame, key: str = "trade_id") -> DataFrame:
    """Trades with the fields that a change gives; a null leaves a field as it was, and a side that is none raises when it is read."""
    side = F.when(F.upper("side").isin("BUY", "SELL"), F.upper("side")).when(F.col("side").isNotNull(), F.raise_error(F.lit("side must be BUY or SELL")))
    given = changes.withColumn("side", side.cast("string")) if "side" in changes.columns else changes
    return coalescing_upsert(trades, given.join(trades.select(key), key, "left_semi"), [key])


def drop_portfolios(portfolios: DataFrame, trades: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """Both tables without the portfolios and their trades."""
    keep = ~F.coalesce(F.col("portfolio_id").isin(ids), F.lit(False))
    return portfolios.where(keep), trades.where(keep)


def rename_portfolios(portfolios: DataFrame, changes: DataFrame) -> DataFrame:
    """Portfolios with new names, trimmed, or other fields; a null leaves a field as it was, and no portfolio comes in."""
    given = changes.withColumn("name", F.trim("name")) if "name" in changes.columns else changes
    return coalescing_upsert(portfolios, given.join(portfolios.select("portfolio_id"), "portfolio_id", "left_semi"), ["portfolio_id"])


def booked_trades(t: Tables) -> DataFrame:
    """What of a batch of trades with errors can be booked, after portfolio 3 was dropped."""
    sent = t.trades.withColumns({"side": F.when(F.day("trade_date") == 1, "HOLD").otherwise(F.lower("side")), "price": F.when(F.day("trade_date") != 2, F.col("price"))})
    good, _ = valid_trades(sent)
    _, kept_trades = drop_portfolios(t.portfolios, good, [3])
    return kept_trades.groupBy("portfolio_id", "side").agg(F.count("*").alias("n"), F.sum("quantity").cast("double").alias("quantity"))


def renamed_portfolios(t: Tables) -> DataFrame:
    changes = t.spark.createDataFrame([(1, " first ", None), (2, None, 5.0), (99, "none", 1.0)], "portfolio_id long, name string, initial_cash double")
    return rename_portfolios(t.portfolios, changes)


def portfolio_positions(t: Tables) -> DataFrame:
    """Open positions; sales lower the cost basis by what they brought."""
    q, amount = F.col("quantity"), F.col("quantity") * F.col("price")
    bought, spent = F.sum(_signed(q, F.lit(0))), F.sum(_signed(amount, F.lit(0)))
    rows = t.trades.groupBy("portfolio_id", "ticker").agg(
        F.sum(_signed(q, -q)).cast("double").alias("quantity"), F.coalesce(half_up(ratio(spent, bought)), F.lit(0.0)).alias("avg_buy_price"),
        F.sum(_signed(amount, -amount) + F.col("fees")).cast("double").alias("cost_basis"), F.min("trade_date").alias("first_trade_date"), F.max("trade_date").alias("last_trade_date"), F.count("*").alias("trade_count"),
    )
    return rows.where("quantity <> 0")


def portfolio_summary(t: Tables) -> DataFrame:
    """Portfolios without trades stay, with zeros."""
    amount = F.col("quantity") * F.col("price")
    money = lambda side, e: F.sum(F.when(F.col("side") == side, e).otherwise(0)).cast("double")
    agg = t.trades.groupBy("portfolio_id").agg(F.count("*").alias("trade_count"), F.count_distinct("ticker").alias("ticker_count"), money("BUY", amount + F.col("fees")).alias("gross_invested"), money("SELL", amount - F.col("fees")).alias("gross_proceeds"))
    return t.portfolios.join(agg, "portfolio_id", "left").fillna(0, ["trade_count", "ticker_count"]).fillna(0.0, ["gross_invested", "gross_proceeds"])


def positions(t: Tables) -> DataFrame:
    rows = portfolio_positions(t).join(latest_price(t), "ticker", "left").join(t.fundamentals.select("ticker", "name"), "ticker", "left")
    value = half_up(F.col("quantity") * F.col("price"), 2)
    gain = half_up(value - F.col("cost_basis"), 2)
    return rows.withColumns({"market_value": value, "unrealised": gain, "unrealised_pct": half_up(ratio(gain, F.col("cost_basis")) * 100, 2)})


def portfolio_value_history(t: Tables) -> DataFrame:
    """Daily marked value: what was held by then, on days with a price of that ticker.

    Positions are running totals per ticker looked up as of each priced day, so days and trades are never paired.
    """
    signed = t.trades.groupBy("portfolio_id", "ticker", "trade_date").agg(F.sum(_signed(F.col("quantity"), -F.col("quantity"))).alias("q"))
    w = Window.partitionBy("portfolio_id", "ticker").orderBy("trade_date")
    held = signed.withColumn("held", F.sum("q").over(w).cast("double"))
    owned = signed.groupBy("portfolio_id", "ticker").agg(F.min("trade_date").alias("since"))
    priced = t.eod_prices.select("ticker", "date", F.coalesce("adjusted_close", "close").alias("px")).join(owned, "ticker").where(F.col("date") >= F.col("since")).drop("since")
    valued = as_of_join(priced, held, ["portfolio_id", "ticker"], "date", "trade_date", {"held": "held"})
    worth = (F.col("held").cast("decimal(18,2)") * F.col("px").cast("decimal(18,4)")).cast("decimal(30,6)")
    return valued.groupBy("portfolio_id", "date").agg(F.sum(worth).cast("double").alias("market_value"))


def trades_with_symbol(t: Tables) -> DataFrame:
    columns = ["portfolio_id", "ticker", "side", "trade_date", F.col("quantity").cast("double").alias("quantity"), F.col("price").cast("double").alias("price"), F.col("fees").cast("double").alias("fees")]
    return t.trades.select(*columns).join(t.fundamentals.select("ticker", "name", "exchange"), "ticker", "left")


def _full(value: Column, w, n: int) -> Column:
    """A rolling value only where the frame holds n rows."""
    return F.when(F.count("close").over(w) == n, value)


def _rolling(ticker_order, n: int):
    return ticker_order.rowsBetween(1 - n, 0)


def sma_overlays(t: Tables, block: int = 65_536) -> DataFrame:
    """Means of the last 20, 50 and 200 closes; long histories lie in blocks of rows with the 199 rows before them."""
    total = lambda n: lambda w: _full(F.sum(F.col("close").cast("decimal(18,4)")).over(_rolling(w, n)).cast("double") / n, _rolling(w, n), n)
    frames = {f"sma_{n}": total(n) for n in (20, 50, 200)} | {"before": lambda w: F.lag("close").over(w)}
    rows = in_blocks(t.eod_prices.select("ticker", "date", "close"), ["ticker"], "date", frames, back=199, block=block)
    means = [half_up(F.col(f"sma_{n}")).alias(f"sma_{n}") for n in (20, 50, 200)]
    return rows.select("ticker", "date", "close", *means, half_up(F.col("close") - F.col("before")).alias("change"))


def bollinger(t: Tables, n: int = 20, width: float = 2.0, block: int = 65_536) -> DataFrame:
    """Bands of two sample deviations, from exact sums of the closes and their squares."""
    c = F.col("close").cast("decimal(12,4)")
    s = lambda w: F.sum(c).over(_rolling(w, n)).cast("double")
    squares = lambda w: F.sum((c * c).cast("decimal(24,8)")).over(_rolling(w, n)).cast("double")
    frames = {
        "m": lambda w: _full(s(w) / n, _rolling(w, n), n),
        "d": lambda w: _full(F.sqrt(F.greatest(F.lit(0.0), (squares(w) - s(w) * s(w) / n) / (n - 1))), _rolling(w, n), n),
    }
    rows = in_blocks(t.eod_prices.select("ticker", "date", "close"), ["ticker"], "date", frames, back=n - 1, block=block)
    band = lambda k, name: half_up(F.col("m") + k * F.col("d"), 3).alias(name)
    return rows.select("ticker", "date", half_up(F.col("m"), 3).alias("middle"), band(width, "upper"), band(-width, "lower"))


def symbol_search(t: Tables, text: str = "brand#2", limit: int = 20) -> DataFrame:
    """Exact before prefix before substring, then the shortest."""
    f = t.fundamentals.where(F.col("ticker").ilike(f"%{text}%") | F.col("name").ilike(f"%{text}%"))
    exact, prefix = F.lower("ticker") == text.lower(), F.lower("ticker").startswith(text.lower())
    return f.orderBy(F.desc(exact), F.desc(prefix), F.length("ticker"), "ticker").limit(limit).select("ticker", "name", "exchange")


def news_for_symbol(t: Tables, symbol: str = "Brand#7", limit: int = 50) -> DataFrame:
    rows = t.news.where(F.array_contains("symbols", symbol))
    return rows.orderBy(F.desc("published_at"), F.desc("event_id")).limit(limit).select("event_id", "title", "ticker", "published_at", "sentiment_polarity")


def news_props(t: Tables) -> DataFrame:
    """The JSON objects of all stories as key and value rows, counted."""
    return t.news.select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))


PLANS = {
    f.__name__: f for f in (booked_trades, renamed_portfolios, portfolio_positions, portfolio_summary, positions, portfolio_value_history, trades_with_symbol, sma_overlays, bollinger, symbol_search, news_for_symbol, news_props)
}
