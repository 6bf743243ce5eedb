"""The dashboard's tabs that show a stored JSON block: valuation, ratings, ESG, each as a table of its fields."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.latest import latest_by
from meridia.operators.variants import block_table
from meridia.sources.domain import Tables

TABS = ("valuation", "ratings", "esg")


def stored_blocks(t: Tables) -> DataFrame:
    """ticker and a JSON text a tab: numbers, text and truth values, nested objects and arrays; some names have none, or one that is no JSON."""
    n = F.substring("ticker", 7, 9).cast("int")
    rating = latest_by(t.analyst_ratings, ["ticker"], ["date"], ["target_price", "strong_buy", "buy", "hold", "sell", "strong_sell"])
    rows = t.fundamentals.select("ticker", "sector", "market_cap", "is_delisted").withColumn("n", n).join(rating, "ticker", "left")
    cap = F.struct(F.floor(F.col("market_cap") / 10000).alias("value"), F.lit("USD").alias("currency"))
    valuation = F.to_json(F.struct(F.col("n").alias("TrailingPE"), F.col("sector").alias("Peer group"), F.col("is_delisted").alias("Delisted"), cap.alias("Capital")))
    counts = {"StrongBuy": "strong_buy", "Buy": "buy", "Hold": "hold", "Sell": "sell", "StrongSell": "strong_sell"}
    ratings = F.to_json(F.struct(F.date_format("date", "yyyy-MM-dd").alias("AsOf"), *[F.col(c).alias(k) for k, c in counts.items()]))
    activity = lambda k: F.struct(F.lit(k).alias("Activity"), F.when((n + len(k)) % 2 == 0, "Yes").otherwise("No").alias("Involvement"))
    activities = F.array(activity("coal"), activity("tobacco"))
    esg = F.when(n % 2 == 0, F.to_json(activities)).otherwise(F.to_json(F.struct((n * 3).alias("TotalEsg"), activities.alias("ActivitiesInvolvement"))))
    return rows.select(
        "ticker",
        F.when(n % 11 == 3, "").otherwise(valuation).alias("valuation"),
        F.when(F.col("date").isNotNull(), ratings).alias("ratings"),
        F.when(n % 11 == 4, "not json").otherwise(esg).alias("esg"),
    )


def tab(t: Tables, name: str) -> DataFrame:
    """The table of a tab for every ticker: ticker, item, key, value, type."""
    if name not in TABS:
        raise ValueError(f"no tab {name}; there are {', '.join(TABS)}")
    return block_table(stored_blocks(t), name, ["ticker"])


PLANS = {f"tab_{name}": partial(tab, name=name) for name in TABS}

_N = "SELECT *, CAST(substr(ticker, 7) AS INTEGER) AS n FROM fundamentals"
_YES = lambda k: f"CASE WHEN (n + {len(k)}) % 2 = 0 THEN 'Yes' ELSE 'No' END"
_OBJECT = lambda k: f"""'{{"Activity":"{k}","Involvement":"' || {_YES(k)} || '"}}'"""
_COUNTS = ("strong_buy", "buy", "hold", "sell", "strong_sell")
_WIDE = "OBJECT<Activity: STRING, Involvement: STRING>"
SQL = {
    "tab_valuation": f"""SELECT ticker, 0 AS item, unnest(['TrailingPE', 'Peer group', 'Delisted', 'Capital']) AS key,
        unnest([CAST(n AS VARCHAR), sector, CAST(is_delisted AS VARCHAR), '{{"currency":"USD","value":' || CAST(floor(market_cap / 10000) AS BIGINT) || '}}']) AS value,
        unnest(['BIGINT', 'STRING', 'BOOLEAN', 'OBJECT<currency: STRING, value: BIGINT>']) AS type FROM ({_N}) WHERE n % 11 <> 3""",
    "tab_ratings": f"""SELECT ticker, 0 AS item, unnest(['AsOf', 'StrongBuy', 'Buy', 'Hold', 'Sell', 'StrongSell']) AS key,
        unnest([CAST(date AS VARCHAR), {", ".join(f"CAST({c} AS VARCHAR)" for c in _COUNTS)}]) AS value,
        unnest(['STRING', {", ".join("'BIGINT'" for _ in _COUNTS)}]) AS type
      FROM (SELECT * FROM analyst_ratings WHERE ticker IN (SELECT ticker FROM fundamentals) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)""",
    "tab_esg": f"""WITH f AS (SELECT * FROM ({_N}) WHERE n % 11 <> 4)
      SELECT ticker, item, unnest(['Activity', 'Involvement']) AS key, unnest([activity, CASE item WHEN 0 THEN {_YES('coal')} ELSE {_YES('tobacco')} END]) AS value, 'STRING' AS type
        FROM f, (VALUES (0, 'coal'), (1, 'tobacco')) a(item, activity) WHERE n % 2 = 0
      UNION ALL SELECT ticker, 0, unnest(['TotalEsg', 'ActivitiesInvolvement']), unnest([CAST(n * 3 AS VARCHAR), '[' || {_OBJECT('coal')} || ',' || {_OBJECT('tobacco')} || ']']),
        unnest(['BIGINT', 'ARRAY<{_WIDE}>']) FROM f WHERE n % 2 = 1""",
}
