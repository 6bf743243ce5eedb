"""The equity tables, derived from the star schema and the event stream.

A brand is a ticker, a supplier a holder, a ship day a trading day; events are insider
transactions and news. Every value is arithmetic on the source rows, so any engine can derive the same.

Tables far smaller than the facts (prices by day, holders, statements, rollups) are kept: the first plan that
needs one writes it to the shared folder, the others read it there, until refresh(). So a plan of many parts
scans the facts once for each such table and application, not once for each use.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import cached_property, reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions.numbers import half_up
from meridia.sources.stored import StoredTable
from meridia.sources.workspace import fingerprint, remove, written

AS_OF = "2001-06-30"
EVENTS_AS_OF = "2024-01-30"
# Floors and row counts of the newsletter.
CONFIG = {"min_price": 5.0, "min_avg_vol_20d": 100000.0, "min_holders": 5, "min_prior_shares": 50000.0, "min_holders_at_latest": 4, "top_n": 5, "top_n_movers": 10}
BENCHMARK = "Brand#1"
BENCHMARKS = (("Brand#1", "First", 10), ("Brand#2", "Second", 20), ("Brand#3", "Third", 30), ("Brand#4", "Fourth", 40))

EARNINGS_DAY = "2001-04-30"


def day(text: str):
    return F.lit(text).cast("date")


#: Line items that a task groups by supplier, about.
ROWS = 1 << 19

#: Up to here an amount with two digits is added up as a whole number of hundredths.
PLAIN = 1e6


def hundredths(c: str) -> Column:
    return F.rint(F.col(c) * 100).cast("bigint")


def plain(*columns: str) -> Column:
    """Whether all the doubles are whole hundredths and not large, so that hundredths() is their decimal(18,2) exactly; not so for nulls and NaN."""
    one = lambda c: (F.abs(F.col(c)) <= PLAIN) & (F.rint(F.col(c) * 100) / 100 == F.col(c))
    return F.coalesce(reduce(lambda a, b: a & b, map(one, columns)), F.lit(False))


#: The setting that names a folder where kept tables outlast the application. Unset, they go when it ends.
VIEWS_DIR = "spark.meridia.views.dir"
#: Where kept tables were written, by application, source folder and name.
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def kept(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """A derived table, or a plan without parameters, that is written once and then read."""

    @wraps(make)
    def table(t: Tables) -> DataFrame:
        return t.keep(make.__name__, lambda: make(t))

    return table


def kept_property(make: Callable[[Tables], DataFrame]) -> cached_property:
    return cached_property(kept(make))


class Tables:
    #: Days that a price counts for, in the universe and elsewhere: the derived names trade seldom.
    universe_days = price_days = 30

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table as this application has it; else as an earlier one left it, if VIEWS_DIR is set; else made now."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            lasting = self._lasting(name)
            if lasting is None:
                _WRITTEN[key] = written(make(), name)
            else:
                if not lasting.exists():
                    lasting.replace(make())
                _WRITTEN[key] = lasting.read()
        return _WRITTEN[key]

    def _lasting(self, name: str) -> StoredTable | None:
        """A stored table named after the sources' files, their sizes and times, so that changed sources are another table."""
        views = self.spark.conf.get(VIEWS_DIR, None)
        return StoredTable(self.spark, f"{views.rstrip('/')}/{fingerprint(self.spark, self.folder)}/{name}", F.lit("all")) if views else None

    def forget(self) -> None:
        """The next use of each kept table derives it from the sources again. Older results may still read the old files."""
        views = self.spark.conf.get(VIEWS_DIR, None)
        if views:
            remove(self.spark, f"{views.rstrip('/')}/{fingerprint(self.spark, self.folder)}")
        for key in [k for k in _WRITTEN if k[:2] == (self.spark.sparkContext.applicationId, self.folder)]:
            del _WRITTEN[key]
        for name, member in vars(type(self)).items():
            if isinstance(member, cached_property):
                self.__dict__.pop(name, None)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """Line items up to AS_OF with ticker, date, and exact decimals. Only the columns that are used are read."""
        money = lambda c: F.col(c).cast("decimal(18,2)")
        line = self.read("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_shipdate").cast("date").alias("date"), money("l_quantity").alias("q"),
            money("l_extendedprice").alias("x"), money("l_discount").alias("disc"), money("l_tax").alias("tax"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
            "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        )
        part = self.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
        return line.where(F.col("date") <= day(AS_OF)).join(part, "l_partkey")

    @cached_property
    def measured(self) -> DataFrame:
        """Line items with the measures that rollups add up: n, q, x, net, taxed, and the extremes top and bottom."""
        net, taxed = F.col("x") * (1 - F.col("disc")), F.col("x") * F.col("tax")
        return self.lines.select("ticker", "l_suppkey", "date", "l_returnflag", F.lit(1).alias("n"), "q", "x", net.alias("net"), taxed.alias("taxed"), F.col("unit").alias("top"), F.col("unit").alias("bottom"))

    @kept_property
    def daily(self) -> DataFrame:
        """The measures by ticker, day and flag, exact sums of decimals: one pass over the facts for all rollups by ticker.

        Plain amounts are added up as whole numbers. The others are part of the key until then, with the number of rows that
        have them: a sum of wide decimals, even of none, took a decimal's objects for each row of the facts.
        """
        raw = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        rows = self.lines.select("ticker", "date", "l_returnflag", "unit", *raw, plain(*raw).alias("plain"))
        q, x, disc, tax = (F.when(F.col("plain"), hundredths(c)) for c in raw)
        wholes = {"q": q, "x": x, "net": x * (100 - disc), "taxed": x * tax}
        odd = F.when(~F.col("plain"), F.struct(*raw)).alias("odd")
        sums = [F.sum(whole).alias(f"_{c}") for c, whole in wholes.items()]
        added = rows.groupBy("ticker", "date", "l_returnflag", odd).agg(F.count("*").alias("n"), *sums, F.max("unit").alias("top"), F.min("unit").alias("bottom"))
        wq, wx, wdisc, wtax = (F.col(f"odd.{c}").cast("decimal(18,2)") for c in raw)
        wides = {"q": (wq, 2, 28), "x": (wx, 2, 28), "net": (wx * (1 - wdisc), 4, 38), "taxed": (wx * wtax, 4, 38)}

        def total(c: str) -> Column:
            wide, digits, places = wides[c]
            whole = F.sum(F.col(f"_{c}").cast("decimal(20,0)")) * F.lit(Decimal(1).scaleb(-digits))
            wide = F.sum(F.when(F.col("odd").isNotNull(), wide * F.col("n").cast("decimal(10,0)")))
            return F.coalesce(whole + wide, whole, wide).cast(f"decimal({places},{digits})").alias(c)

        totals = [total(c) for c in wides]
        return added.groupBy("ticker", "date", "l_returnflag").agg(F.sum("n").alias("n"), *totals, F.max("top").alias("top"), F.min("bottom").alias("bottom"))

    def _prices(self, rows: DataFrame, key: str) -> DataFrame:
        total = lambda c: F.sum(c).cast("double")
        close = half_up(total("x") / total("q"))
        return rows.groupBy(F.col(key).alias("ticker"), "date").agg(
            close.alias("close"), close.alias("adjusted_close"), half_up(F.max("top")).alias("high"), half_up(F.min("bottom")).alias("low"), (F.sum("q") * 10000).cast("bigint").alias("volume")
        )

    @kept_property
    def eod_prices(self) -> DataFrame:
        return self._prices(self.daily, "ticker")

    @cached_property
    def eod_prices_x(self) -> DataFrame:
        """A wider cross-section: suppliers as tickers. Nearly as large as the facts, so it is not kept: a plan derives the days and columns that it asks for."""
        return self._prices(self.measured, "l_suppkey").withColumn("ticker", F.col("ticker").cast("string"))

    @kept_property
    def fundamentals(self) -> DataFrame:
        number = F.substring("p_brand", 7, 9).cast("int")
        part = self.read("part").withColumn("number", number)
        grouped = part.groupBy(F.col("p_brand").alias("ticker"), "number").agg(
            F.min("p_name").alias("name"), F.min("p_type").alias("first_type"), F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("retail"), F.count("*").alias("parts")
        )
        n = F.col("number")
        return grouped.select(
            "ticker", "name", F.concat(F.lit("Sector "), (n % 5).cast("string")).alias("sector"), F.concat(F.lit("Industry "), (n % 7).cast("string")).alias("industry"),
            (F.col("retail") * 10000).alias("market_cap"), F.when(n % 6 == 0, None).otherwise(8.0 + (n * 7) % 23).alias("pe_ratio"), (0.5 + (n % 4) * 0.5).alias("peg_ratio"),
            ((n % 9) / 20.0).alias("profit_margin"), ((n % 8) / 25.0).alias("return_on_equity"), ((n % 5) / 50.0).alias("dividend_yield"), ((n % 11) / 30.0).alias("quarterly_revenue_growth"),
            ((n % 13) / 40.0).alias("quarterly_earnings_growth"), (n % 12 == 11).alias("is_delisted"), F.when(n % 10 == 0, "ETF").when(n % 7 == 0, None).otherwise("Common Stock").alias("type"),
            F.when(n % 3 == 0, "NYSE").otherwise("NASDAQ").alias("exchange"), F.when(n % 8 == 5, day("2000-06-30")).alias("delisted_on"),
        )

    @kept_property
    def moves(self) -> DataFrame:
        """What each supplier moved of each ticker: shares in all, and those of its last quarter and of its last month.

        One pass over the facts and one shuffle of them, read twice, for both kinds of holders. Suppliers with one name, or of one nation, are added up from
        this: of a holder's last period only those count whose own last period it is. Shares are whole numbers, as quantities have two digits.
        """
        shares = F.when(plain("l_quantity"), hundredths("l_quantity") * 10).otherwise((F.col("l_quantity").cast("decimal(18,2)") * 1000).cast("bigint"))
        moved = F.when(F.col("l_returnflag") == "R", -shares).otherwise(shares)
        # a count of its own: merged into a task a core, the groups below outgrow its memory and are spilled
        tasks = max(1, -(-self.read("lineitem").count() // ROWS))
        # a join loses null keys: a ticker without a name is told apart by a column of its own, suppliers without a key hold nothing
        key = ["ticker", "unnamed", "l_suppkey"]
        lines = self.lines.where("l_suppkey is not null").select(F.coalesce("ticker", F.lit("")).alias("ticker"), F.col("ticker").isNull().alias("unnamed"), "l_suppkey", F.last_day("date").alias("month"), moved.alias("moved"))
        lines = lines.where("month is not null").repartition(tasks, *key)
        # most groups by quarter would have one row: the same shuffle is read twice, for the last month and then for the rows of its quarter alone
        last = lines.groupBy(*key).agg(F.sum("moved").alias("whole"), F.max("month").alias("last")).withColumn("begin", F.trunc("last", "QUARTER"))
        both = lines.join(last.hint("shuffle_hash"), key).where(F.col("month") >= F.col("begin"))
        same = lambda c: F.first(c).alias(c)
        ends = both.groupBy(*key).agg(same("whole"), same("last"), F.sum("moved").alias("in_quarter"), F.sum(F.when(F.col("month") == F.col("last"), F.col("moved"))).alias("in_month"))
        quarter = F.last_day(F.add_months(F.trunc("last", "QUARTER"), 2)).alias("quarter")
        return ends.select(F.when(~F.col("unnamed"), F.col("ticker")).alias("ticker"), "l_suppkey", F.col("whole").alias("moved"), quarter, "in_quarter", F.col("last").alias("month"), "in_month")

    def _holdings(self, holder: str, period: str, cut: int) -> DataFrame:
        """Each holder's last filing by ticker, one row for both: shares held up to then and their last change."""
        supplier = self.read("supplier").join(self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
        supplier = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col(holder).alias("holder_name"))
        # moves grow with the facts: a broadcast would send them to the driver whole
        filed = self.moves.hint("merge").join(supplier, "l_suppkey").groupBy("ticker", "holder_name", F.col(period).alias("report_date"))
        filed = filed.agg(F.sum("moved").alias("moved"), F.sum(f"in_{period}").alias("change"))
        held = filed.groupBy("ticker", "holder_name").agg(F.sum("moved").cast("double").alias("shares_held"), F.max("report_date").alias("report_date"), F.max_by("change", "report_date").cast("double").alias("change_shares"))
        held = held.select("ticker", "holder_name", "report_date", "shares_held", "change_shares").where("shares_held > 0")
        held = written(held, "held")  # read three times below
        by_ticker = held.groupBy("ticker").agg(F.sum("shares_held").alias("all_shares"))
        by_holder = held.groupBy("holder_name").agg(F.sum("shares_held").alias("whole_book"))
        prior = F.col("shares_held") - F.col("change_shares")
        return held.join(by_ticker, "ticker").join(by_holder, "holder_name").select(
            "ticker", "holder_name", "report_date", F.date_add("report_date", 5).alias("observed_at"), "shares_held", half_up(F.col("shares_held") / F.col("all_shares") * 100).alias("pct_shares"),
            half_up(F.col("shares_held") / F.col("whole_book") * 100).alias("pct_assets"), F.when(F.length("holder_name") % cut == cut - 1, None).otherwise(F.col("change_shares")).alias("change_shares"),
            F.when(prior == 0, 0.0).otherwise(half_up(F.col("change_shares") / prior * 100)).alias("change_pct"),
        )

    @kept_property
    def institutional_holders(self) -> DataFrame:
        return self._holdings("s_name", "quarter", 97)

    @kept_property
    def fund_holders(self) -> DataFrame:
        return self._holdings("n_name", "month", 5)

    @kept_property
    def statements(self) -> DataFrame:
        """A row for each ticker and year: income, balance and cash flow in one. The filing date is null for some."""
        return self._statements(self.daily, "ticker")

    @kept_property
    def statements_x(self) -> DataFrame:
        return self._statements(self.measured, "l_suppkey").withColumn("ticker", F.col("ticker").cast("string"))

    def _statements(self, rows: DataFrame, key: str) -> DataFrame:
        flag = lambda c, e: F.sum(F.when(F.col("l_returnflag") == c, e)).cast("double")
        year = rows.groupBy(F.col(key).alias("ticker"), F.year("date").alias("year")).agg(
            F.sum("net").cast("double").alias("revenue"), F.sum("taxed").cast("double").alias("ebitda"), flag("R", F.col("x")).alias("returned"),
            flag("A", F.col("x")).alias("accepted"), F.sum("q").cast("double").alias("units"), F.sum("n").alias("lines"),
        )
        end = F.make_date("year", F.lit(12), F.lit(31))
        value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        return year.where(end <= day(AS_OF)).select(
            "ticker", end.alias("date"), F.when(F.col("lines") % 4 == 0, None).otherwise(F.date_add(end, 45)).alias("filing_date"), half_up(F.col("revenue"), 2).alias("total_revenue"),
            half_up(F.col("revenue") - value("returned"), 2).alias("gross_profit"), half_up(value("accepted") - value("returned"), 2).alias("net_income"), half_up(F.col("ebitda"), 2).alias("ebitda"),
            half_up(F.col("units") * 1000, 2).alias("total_assets"), half_up(F.col("units") * 400, 2).alias("total_current_assets"), (F.col("lines") * 5000.0).alias("total_current_liabilities"),
            (F.col("lines") * 9000.0).alias("long_term_debt"), half_up(F.col("units") * 600, 2).alias("total_stockholder_equity"), (F.col("lines") * 700.0).alias("cash"),
            half_up(F.col("revenue") * 0.1 - value("returned") * 0.05, 2).alias("free_cash_flow"), half_up(F.col("revenue") * 0.15 - value("returned") * 0.05, 2).alias("operating_cash_flow"),
            (F.col("units") * 100).alias("shares"),
        )

    @kept_property
    def earnings_history(self) -> DataFrame:
        from pyspark.sql import Window

        quarter = F.last_day(F.add_months(F.trunc("date", "QUARTER"), 2))
        eps = half_up(F.sum("net").cast("double") / F.sum("q").cast("double") / 100)
        rows = self.daily.groupBy("ticker", quarter.alias("date")).agg(eps.alias("eps_actual")).where(F.col("date") <= day(AS_OF))
        last4 = Window.partitionBy("ticker").orderBy("date").rowsBetween(-4, -1)
        rows = rows.withColumn("eps_estimate", half_up(F.avg("eps_actual").over(last4)))
        surprise = half_up((F.col("eps_actual") / F.col("eps_estimate") - 1) * 100)
        return rows.select("ticker", F.date_add("date", 30).alias("report_date"), "date", "eps_actual", "eps_estimate", F.when(F.col("eps_estimate") > 0, surprise).alias("surprise_pct"))

    @kept_property
    def analyst_ratings(self) -> DataFrame:
        quarter = F.last_day(F.add_months(F.trunc("date", "QUARTER"), 2))
        units = F.sum("q").cast("bigint")
        rows = self.daily.groupBy("ticker", quarter.alias("date")).agg(units.alias("u"), F.max("top").alias("top"), F.sum("n").alias("n"))
        u = F.col("u")
        return rows.where(F.col("date") <= day(AS_OF)).select(
            "ticker", "date", F.when(F.col("n") % 9 == 0, None).otherwise(1.0 + (u % 401) / 100.0).alias("rating"), half_up(F.col("top") * 0.9).alias("target_price"),
            (u % 7).cast("int").alias("strong_buy"), (u % 5).cast("int").alias("buy"), (u % 3).cast("int").alias("hold"), (u % 4).cast("int").alias("sell"), (u % 2).cast("int").alias("strong_sell"),
        )

    @kept_property
    def dividends(self) -> DataFrame:
        quarter = F.last_day(F.add_months(F.trunc("date", "QUARTER"), 2))
        rows = self.daily.where(F.col("l_returnflag") == "A").groupBy("ticker", quarter.alias("ex_date")).agg((F.sum("q").cast("double") / F.sum("n")).alias("v"))
        return rows.where(F.col("ex_date") <= day(AS_OF)).select("ticker", "ex_date", half_up(F.col("v") / 10).alias("value"))

    @cached_property
    def insider_transactions(self) -> DataFrame:
        e, k = self.read("events"), F.col("event_id")
        made = F.col("ts").cast("date")
        code = F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "error", "S").otherwise("A")
        return e.select(
            k, F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 25).cast("string")).alias("ticker"), made.alias("transaction_date"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("owner_name"),
            F.when(F.col("user_id") % 2 == 0, "Director").otherwise("Officer").alias("relationship"), code.alias("transaction_code"), (10 + k % 90).cast("double").alias("shares"),
            F.col("value").alias("price"), half_up((10 + k % 90) * F.col("value"), 2).alias("value"), F.when(k % 3 == 0, None).otherwise(F.date_add(made, (k % 5).cast("int"))).alias("report_date"),
        )

    @kept_property
    def sentiment_daily(self) -> DataFrame:
        rows = self.read("events").groupBy(F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 25).cast("string")).alias("ticker"), F.col("ts").cast("date").alias("date"))
        total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
        return rows.agg(F.count("*").alias("count"), total.alias("v")).select("ticker", "date", "count", half_up(F.col("v") / F.col("count") / 100).alias("normalized"))

    @cached_property
    def news(self) -> DataFrame:
        k = F.col("event_id")
        symbol = lambda shift: F.concat(F.lit("Brand#"), (1 + (F.col("user_id") + shift) % 25).cast("string"))
        return self.read("events").select(
            k, F.concat(F.lit("story "), (k % 4000).cast("string")).alias("title"), symbol(0).alias("ticker"), F.array(symbol(0), symbol(3)).alias("symbols"), F.col("ts").alias("published_at"),
            ((k % 41) / 20.0 - 1.0).alias("sentiment_polarity"), "props",
        )

    @cached_property
    def trades(self) -> DataFrame:
        orders = self.read("orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
        t = self.lines.join(orders, "l_orderkey")
        return t.select(
            (F.col("o_custkey") % 10).alias("portfolio_id"), "ticker", F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("date").alias("trade_date"),
            F.col("q").alias("quantity"), half_up(F.col("unit")).cast("decimal(18,4)").alias("price"), (F.col("tax") * F.col("x")).cast("decimal(18,4)").alias("fees"),
        )

    @cached_property
    def portfolios(self) -> DataFrame:
        """Twelve portfolios, two of them without trades."""
        ids = self.read("customer").select((F.col("c_custkey") % 12).cast("bigint").alias("id")).distinct()
        return ids.select(F.col("id").alias("portfolio_id"), F.concat(F.lit("book "), F.col("id").cast("string")).alias("name"), (F.col("id") * 1000.0).alias("initial_cash"))

    # What the stock study reads: like the tables above, with growth that differs from name to name, so that some pass its gates.

    @kept_property
    def growth_statements(self) -> DataFrame:
        """A row for each ticker and year."""
        year = self.daily.groupBy("ticker", F.year("date").alias("year")).agg(
            F.sum("net").cast("double").alias("revenue"),
            F.sum("q").cast("double").alias("units"),
            F.sum("n").alias("lines"),
        )
        n = F.substring("ticker", 7, 9).cast("int")
        sales = F.col("revenue") * F.pow(1 + (n * 3) % 8 * F.lit(0.04), F.col("year") - 1990)
        pretax = sales * (n % 6 - 1) / 20.0
        end = F.make_date("year", F.lit(12), F.lit(31))
        return year.where(end <= day(AS_OF)).select(
            "ticker",
            end.alias("date"),
            half_up(sales, 2).alias("total_revenue"),
            half_up(pretax, 2).alias("income_before_tax"),
            half_up(pretax * 0.7, 2).alias("net_income"),
            (F.col("lines") * 3000.0 * (n % 4)).alias("long_term_debt"),
            (F.col("lines") * 500.0).alias("short_term_debt"),
            (F.col("units") * 600).alias("total_stockholder_equity"),
        )

    @kept_property
    def growth_earnings(self) -> DataFrame:
        """ticker, date (a quarter's end), eps_actual; some are not known."""
        n = F.substring("ticker", 7, 9).cast("int")
        eps = half_up(F.col("eps_actual") * F.pow(1 + (n * 5) % 7 * F.lit(0.04), F.year("date") - 1998))
        missing = (n % 9 == 4) & (F.month("date") == 3)
        return self.earnings_history.select("ticker", "date", F.when(~missing, eps).alias("eps_actual"))

    @kept_property
    def earnings_trend(self) -> DataFrame:
        """Estimated growth by period, as seen on two days."""
        n = F.substring("ticker", 7, 9).cast("int")
        base = (n * 5) % 7 * F.lit(0.04)
        of = lambda period, given, growth: F.when(given, F.struct(F.lit(period).alias("period"), growth.alias("growth")))
        periods = F.array_compact(F.array(of("+5y", n % 3 == 0, base + 0.02), of("+1y", n % 3 <= 1, base - 0.05), of("0y", n > 0, base + 0.3)))
        seen = F.explode(F.array(day("2001-03-31"), day(AS_OF))).alias("date")
        rows = self.fundamentals.select("ticker", n.alias("n"), F.explode(periods).alias("p")).select("*", seen)
        last = F.col("date") == day(AS_OF)
        growth = F.when(last & (F.col("n") % 5 == 0), None).when(last, F.col("p.growth")).otherwise(F.col("p.growth") + 0.001)
        return rows.select("ticker", "date", "p.period", half_up(growth).alias("growth"))
