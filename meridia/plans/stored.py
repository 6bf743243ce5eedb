"""What is stored and kept up to date: upserts into sliced tables, prices by partial sums, and the bank of vintages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions.numbers import half_up
from meridia.operators.upsert import coalescing_upsert, enrich, insert_ignore, upsert, upsert_partial
from meridia.sources.domain import Tables, day
from meridia.sources.stored import StoredTable, by_bucket, by_month
from meridia.sources.workspace import new_folder

from . import flows, writes

KEY = ["ticker", "date"]


def _stored(t: Tables, old: DataFrame, new: DataFrame, how) -> DataFrame:
    """The table after the old rows were stored and the new ones merged; only the months of the new ones are written twice."""
    table = StoredTable(t.spark, new_folder(t.spark, "stored"), by_month("date"))
    table.replace(old)
    table.merge(new, how)
    return table.read()


def _plan(how):
    return lambda t: _stored(t, writes._old(t), writes._new(t), how)


class PriceView:
    """Daily prices as partial sums by ticker and day, in a slice a month. New line items are added without reading the old ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = StoredTable(spark, path, by_month("date"))

    @staticmethod
    def _sums(lines: DataFrame) -> DataFrame:
        wide = lambda c: F.sum(c).cast("decimal(28,2)").alias(c)
        return lines.groupBy("ticker", "date").agg(wide("x"), wide("q"), F.max("unit").alias("top"), F.min("unit").alias("low"))

    @staticmethod
    def _added(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new).groupBy("ticker", "date")
        wide = lambda c: F.sum(c).cast("decimal(28,2)").alias(c)
        return both.agg(wide("x"), wide("q"), F.max("top").alias("top"), F.min("low").alias("low"))

    def add(self, lines: DataFrame) -> list[str]:
        """Gives the months that were written. Line items are those of Tables.lines; each may be added once."""
        return self.table.merge(self._sums(lines), self._added)

    def prices(self, months: list[str] | None = None) -> DataFrame:
        close = half_up(F.col("x").cast("double") / F.col("q").cast("double"))
        return self.table.read(months).select(
            "ticker", "date", close.alias("close"), close.alias("adjusted_close"), half_up(F.col("top")).alias("high"),
            half_up(F.col("low")).alias("low"), (F.col("q") * 10000).cast("bigint").alias("volume"),
        )


def refreshed_prices(t: Tables) -> DataFrame:
    """All prices, from a view that took in line items up to the middle of June first and then the later ones, in two lots."""
    view = PriceView(t.spark, new_folder(t.spark, "price-view"))
    late = F.col("date") > day("2001-06-15")
    view.add(t.lines.where(~late))
    for half in (0, 1):
        view.add(t.lines.where(late & (F.col("l_orderkey") % 2 == half)))
    return view.prices()


class VintageBank:
    """Vintages with intervals of validity. Open ones, one a ticker, are the state; closed ones are only ever added to.

    A ticker is banked when it is new or one of the compared columns has moved, once a day at most. A day before
    the last one banked of a ticker changes nothing for it.
    """

    def __init__(self, spark: SparkSession, path: str, compared: list[str], buckets: int = 16):
        self.compared = compared
        self.open = StoredTable(spark, f"{path}/open", by_bucket(["ticker"], buckets))
        self.closed = StoredTable(spark, f"{path}/closed", by_month("valid_to"))

    def bank(self, current: DataFrame, banked_at: str) -> None:
        """Closed intervals are stored before the state moves on; should the job die between, the same call makes them again and ignores those there."""
        at = day(banked_at)
        now = current.withColumn("valid_from", at)
        if self.open.exists():
            state = self.open.read()
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.compared], F.lit(True))
            known = state.select("ticker", F.col("valid_from").alias("_from"), *[F.col(c).alias(f"_{c}") for c in self.compared])
            now = now.join(known, "ticker", "left").where(F.col("_from").isNull() | (~same & (F.col("_from") < at))).select(*now.columns)
            gone = state.join(now.select("ticker"), "ticker", "left_semi").withColumn("valid_to", at)
            self.closed.merge(gone, lambda old, new: insert_ignore(old, new, ["ticker", "valid_from"]))
        self.open.merge(now, lambda old, new: upsert(old, new, ["ticker"]))

    def vintages(self) -> DataFrame:
        """All vintages: the columns banked, valid_from, and valid_to, null while a vintage is open."""
        found = self.open.read().withColumn("valid_to", F.lit(None).cast("date"))
        return found.unionByName(self.closed.read()) if self.closed.exists() else found

    def as_of(self, date: Column) -> DataFrame:
        return self.vintages().where((F.col("valid_from") <= date) & (F.col("valid_to").isNull() | (F.col("valid_to") > date)))


#: Days that the bank below is fed on, the second one twice, and what then moves.
BANKED = (
    ("2001-04-15", "latest_filing <= date '2001-03-31'", "net_change_pct"),
    ("2001-06-30", "true", "net_change_pct + n_added % 2"),
    ("2001-06-30", "n_added % 5 = 0", "net_change_pct + 5"),
    ("2001-07-15", "true", "net_change_pct + if(n_added % 3 = 0, 2, n_added % 2)"),
)


def _bank(t: Tables) -> VintageBank:
    bank = VintageBank(t.spark, new_folder(t.spark, "bank"), flows.INST_COMPARED)
    now = flows.inst_flow_ticker(t)
    for date, there, value in BANKED:
        bank.bank(now.where(there).withColumn("net_change_pct", F.expr(value).cast("double")), date)
    return bank


_SHOWN = ["ticker", "valid_from", "valid_to", "net_change_pct", "latest_filing", "top_n_holders"]


def vintage_bank(t: Tables) -> DataFrame:
    return _bank(t).vintages().select(*_SHOWN)


def vintage_bank_asof(t: Tables) -> DataFrame:
    """What was known on three days."""
    bank = _bank(t)
    days = ["2001-05-01", "2001-06-30", "2001-12-31"]
    return reduce(DataFrame.unionByName, [bank.as_of(day(d)).select(day(d).alias("as_of"), "ticker", "valid_from", "net_change_pct") for d in days])


PLANS = {
    "stored_upsert": _plan(lambda old, new: upsert(old, new, KEY)),
    "stored_upsert_partial": _plan(lambda old, new: upsert_partial(old, new, KEY, ["volume"])),
    "stored_coalescing_upsert": _plan(lambda old, new: coalescing_upsert(old, new, KEY)),
    "stored_insert_ignore": _plan(lambda old, new: insert_ignore(old, new, KEY)),
    "stored_enrich": _plan(lambda old, new: enrich(old, new, KEY, ["volume"])),
    "refreshed_prices": refreshed_prices,
    "vintage_bank": vintage_bank,
    "vintage_bank_asof": vintage_bank_asof,
}


def _banked_sql() -> str:
    """One CTE a run: the rows that differ from each ticker's last vintage, unless it has one of that day."""
    columns = ", ".join(flows.INST_COMPARED)
    parts, so_far = [], ""
    for k, (date, there, value) in enumerate(BANKED):
        value = value.replace("if(n_added % 3 = 0, 2, n_added % 2)", "CASE WHEN n_added % 3 = 0 THEN 2 ELSE n_added % 2 END")
        rows = f"SELECT DATE '{date}' AS valid_from, * REPLACE ({value} AS net_change_pct) FROM inst_flow_ticker WHERE {there}"
        if so_far:
            last = f"SELECT * FROM ({so_far}) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY valid_from DESC) = 1"
            now, then = (f"({', '.join(f'{side}.{c}' for c in columns.split(', '))})" for side in ("r", "l"))
            rows = f"""SELECT r.* FROM ({rows}) r LEFT JOIN ({last}) l ON l.ticker = r.ticker
              WHERE l.ticker IS NULL OR ({now} IS DISTINCT FROM {then} AND l.valid_from < r.valid_from)"""
        parts.append(f"b{k} AS ({rows})")
        so_far = " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(k + 1))
    intervals = f"SELECT *, lead(valid_from) OVER (PARTITION BY ticker ORDER BY valid_from) AS valid_to FROM ({so_far})"
    return f"{', '.join(parts)}, banked AS ({intervals})"


SQL = {
    **{f"stored_{n}": writes.SQL[n] for n in ("upsert", "upsert_partial", "coalescing_upsert", "insert_ignore")},
    "stored_enrich": writes.SQL["enrich_in_place"],
    "refreshed_prices": "SELECT * FROM eod_prices",
    "vintage_bank": f"WITH {_banked_sql()} SELECT {', '.join(_SHOWN)} FROM banked",
    "vintage_bank_asof": f"""WITH {_banked_sql()} SELECT as_of, ticker, valid_from, net_change_pct FROM banked,
      (VALUES (DATE '2001-05-01'), (DATE '2001-06-30'), (DATE '2001-12-31')) d(as_of) WHERE valid_from <= as_of AND (valid_to IS NULL OR valid_to > as_of)""",
}
