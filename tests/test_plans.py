"""Every plan against its SQL in another engine, and the rules that single tickers must follow."""

import os
from datetime import date
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from meridia.plans import flows, signals, strategies
from meridia.plans.catalog import PLANS, oracles
from meridia.plans.ssg import ESTIMATORS, focus_forecast
from meridia.sources.domain import Tables

FOLDER = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canonical(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
            return str(v)
        return repr(float(v))

    return sorted("|".join(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracles()))
def test_plan_equals_its_sql(spark, duck, name):
    got = PLANS[name](Tables(spark, FOLDER)).toPandas()
    want = duck.execute(oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_queries_and_sql_have_matching_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def tables(spark, **frames):
    base = {"fundamentals": spark.createDataFrame([("T", False, None, "N", "S", 1e9)], "ticker string, is_delisted boolean, type string, exchange string, sector string, market_cap double")}
    return SimpleNamespace(spark=spark, keep=lambda name, make: make(), **(base | frames))


def prices(spark, *rows):
    return spark.createDataFrame([("T", date.fromisoformat(d), p, p) for d, p in rows], "ticker string, date date, adjusted_close double, close double")


@pytest.mark.parametrize(
    "rows,value,reason",
    [
        ([("2018-08-14", 40.0), ("2019-07-12", 50.0)], 0.25, None),
        ([("2018-08-14", 64.0), ("2019-07-12", 40.0), ("2019-08-01", 99.0)], -0.375, None),
        ([("2019-07-12", 50.0)], None, "insufficient_price_history"),
        ([("2018-08-10", 64.0), ("2019-06-20", 40.0)], None, "stale_price_window"),
    ],
)
def test_momentum(spark, rows, value, reason):
    got = signals.sig_momentum(tables(spark, eod_prices=prices(spark, *rows)), as_of="2019-08-15").first()
    assert (got.value, got.reason) == (value, reason)


def earnings(spark, *eps):
    rows = [("T", date(2018, 3 * k, 25), date(2018, 3 * k, 25), e) for k, e in enumerate(eps, 1)]
    return spark.createDataFrame(rows, "ticker string, date date, report_date date, eps_actual double")


@pytest.mark.parametrize(
    "eps,price,value,reason",
    [
        ([0.55, 0.65, 0.75, 0.45], 32.0, 0.075, None),
        ([-1.1, 0.2, 0.3, -0.4], 25.0, -0.04, None),
        ([2.0, 2.0, 2.0], 25.0, None, "insufficient_eps_history"),
        ([2.0] * 4, None, None, "no_price"),
    ],
)
def test_value(spark, eps, price, value, reason):
    have = prices(spark, *([("2019-08-14", price)] if price else []))
    got = signals.sig_value(tables(spark, eod_prices=have, earnings_history=earnings(spark, *eps)), as_of="2019-08-15").first()
    assert (got.value, got.reason) == (value, reason)


def trades(spark, *rows):
    return spark.createDataFrame([("T", date.fromisoformat(d), f"o{k}", c, v, date.fromisoformat(r) if r else None) for k, (d, c, v, r) in enumerate(rows)], "ticker string, transaction_date date, owner_name string, transaction_code string, value double, report_date date")


@pytest.mark.parametrize(
    "rows,value,reason",
    [
        ([("2021-09-01", "P", 3e5, None), ("2021-09-02", "S", 1.25e5, None)], 1.75e5, None),
        ([("2021-09-01", "P", 4e4, None), ("2021-09-02", "S", 9e4, "2021-09-03")], -5e4, None),
        ([("2021-09-01", "P", 7e4, None), ("2021-09-02", "S", 7e4, None)], 0.0, None),
        ([("2021-09-01", "P", 7e4, None)], None, "below_min_txns"),
        ([], None, "no_activity"),
        ([("2021-09-18", "P", 1.0, None), ("2021-09-01", "P", 1.0, "2021-09-25")], None, "no_activity"),
    ],
)
def test_insider(spark, rows, value, reason):
    got = signals.sig_insider(tables(spark, insider_transactions=trades(spark, *rows)), as_of="2021-09-20").first()
    assert (got.value, got.reason) == (value, reason)


def test_insider_windows_are_thirty_days(spark):
    old = trades(spark, ("2024-01-05", "P", 1e5, None), ("2024-01-06", "P", 1e5, None), ("2023-12-31", "P", 1e5, None))
    got = signals.sig_insider(tables(spark, insider_transactions=old)).first()
    assert (got.value, got.n_txns) == (2e5, 2)
    days = {f.__name__: f.__defaults__[0] for f in (strategies.congressional_trading, strategies.congressional_selling_alert)}
    assert set(days.values()) == {30}


def test_what_is_learned_later_changes_nothing(spark):
    rows = [("2021-09-01", "P", 3e5, None), ("2021-09-02", "S", 1.25e5, None)]
    late = [("2021-09-03", "P", 6e5, "2021-10-04"), ("2021-09-21", "P", 6e5, None)]
    one, two = (signals.sig_insider(tables(spark, insider_transactions=trades(spark, *r)), as_of="2021-09-20").first() for r in (rows, rows + late))
    assert one == two


def test_select(spark):
    df = spark.createDataFrame([("K", 0.0), ("L", 7.5), ("M", None), ("N", 2.5), ("O", 4.0)], "ticker string, value double")
    got = sorted(signals.select_rank(df).collect(), key=lambda r: r["rank"])
    assert [r.ticker for r in got] == ["L", "O", "N", "K"] and got[0].excluded == 1
    assert [r.ticker for r in sorted(signals.select_rank(df, False).collect(), key=lambda r: r["rank"])] == ["K", "N", "O", "L"]


def holders(spark, n=6, change=1.0, held=20_000.0, latest="2021-06-30"):
    rows = [("T", f"h{k}", date.fromisoformat(latest if k else "2021-03-31"), date(2021, 7, 5), held, 1.0, 2.0, change, 5.0) for k in range(n)]
    return spark.createDataFrame(rows, "ticker string, holder_name string, report_date date, observed_at date, shares_held double, pct_shares double, pct_assets double, change_shares double, change_pct double")


def test_flows_label_and_anchor(spark):
    rows = [("T", "a", 10.0, 10.0), ("T", "b", 10.0, 0.0), ("T", "c", 10.0, 4.0), ("T", "d", 10.0, -4.0), ("T", "e", 10.0, None)]
    df = spark.createDataFrame([(t, h, date(2021, 6, 30), None, s, 1.0, 1.0, c, 9.0) for t, h, s, c in rows], holders(spark).schema)
    got = {r.holder_name: (r.action, r.change_pct_clean) for r in flows.inst_flow(tables(spark, institutional_holders=df)).collect()}
    assert got == {"a": ("initiated", None), "b": ("unchanged", 9.0), "c": ("added", 9.0), "d": ("trimmed", 9.0)}
    one = flows.inst_flow_ticker(tables(spark, institutional_holders=holders(spark, 20, 100.0))).first()
    assert (one.top_n_holders, one.top_n_at_cap, one.holders_at_latest, one.holders_lagging) == (20, True, 19, 1)
    assert one.net_change_pct == pytest.approx(0.5)


@pytest.mark.parametrize("kw,reason", [({}, None), ({"n": 4}, "below_min_holders"), ({"held": 100.0}, "below_min_prior_shares")])
def test_institutional_flow(spark, kw, reason):
    t = tables(spark, institutional_holders=holders(spark, **kw))
    now = flows.inst_flow_ticker(t).withColumn("banked_at", F.lit("2021-07-06").cast("date"))
    none = now.where("false")
    assert signals.sig_institutional_flow(t, "2021-09-20", none).first().reason == reason
    assert signals.sig_institutional_flow(t, "2021-09-20", now).first().reason == reason
    assert signals.sig_institutional_flow(t, "2021-01-31", now).first().reason == "no_vintage_as_of"


def test_a_capped_fall_is_a_lower_bound(spark):
    t = tables(spark, institutional_holders=holders(spark, 20, -500.0))
    got = signals.sig_institutional_flow(t, "2021-09-20", flows.inst_flow_ticker(t).where("false").withColumn("banked_at", F.lit(None).cast("date"))).first()
    assert got.value < 0 and got.reading_is_lower_bound


def forecast(spark, levels, **kw):
    extra = {"analyst_growth": kw.pop("analyst")} if "analyst" in kw else {}
    df = spark.createDataFrame([("T", levels, *extra.values())], "t string, levels array<double>" + "".join(f", {k} double" for k in extra))
    return focus_forecast(df, ["t"], **kw).first()


def test_focus_forecast(spark):
    steady = [50 * 1.09**k for k in range(9)]
    assert forecast(spark, steady).growth == pytest.approx(0.09)
    assert forecast(spark, [5 * 1.5**k for k in range(6)], cap=0.25).growth == 0.25
    blended = forecast(spark, steady, analyst=0.05)
    assert blended.growth == pytest.approx(0.07) and blended.method.endswith("+analyst")
    far = forecast(spark, steady, analyst=0.4)
    assert far.growth == pytest.approx(0.09) and "analyst" not in far.method
    assert forecast(spark, [3.0, 4.0]) is None
    assert forecast(spark, [2.0, None, -1.0, 5.0, 6.0]).method == brute_method([2.0, -1.0, 5.0, 6.0])


def test_growth_estimators(spark):
    import numpy as np
    s = [3.0, 4.0, 2.0, 5.0, 6.0, 9.0, 8.0]
    row = spark.createDataFrame([(s,)], "s array<double>").select(*[f(F.col("s")).alias(n) for n, f in ESTIMATORS.items()]).first()
    steps = [b / a - 1 for a, b in zip(s, s[1:])]
    assert row.logfit_trend == pytest.approx(np.exp(np.polyfit(range(7), np.log(s), 1)[0]) - 1)
    assert row.cagr_full == pytest.approx((8 / 3) ** (1 / 6) - 1)
    assert row.cagr_5yr == pytest.approx((8 / 4) ** (1 / 5) - 1)
    assert row.cagr_3yr == pytest.approx((8 / 5) ** (1 / 3) - 1)
    assert row.mean_yoy == pytest.approx(np.average(steps, weights=range(1, 7)))
    assert row.last_yoy == pytest.approx(8 / 9 - 1)
    none = spark.createDataFrame([([-1.0, 0.0, -2.0],)], "s array<double>").select(*[f(F.col("s")).alias(n) for n, f in ESTIMATORS.items()]).first()
    assert set(none) == {None}


def test_a_section_without_a_run_says_so(spark):
    from meridia.plans import newsletter

    t = tables(spark)
    some = spark.createDataFrame([(1, "T", "Tea", "hold", False, 2.5, 3, 4)], "rank int, ticker string, name string, verdict string, rated boolean, rating double, n_ratings int, signal_count long")
    got = newsletter.findings(t, {"strategy_picks": lambda t: some.where("false")}).collect()
    assert [(r.section, r.rank, r.ticker, r.facts) for r in got] == [("strategy_picks", 1, None, '{"status":"no_run"}')]
    got = newsletter.findings(t, {"strategy_picks": lambda t: some}).collect()
    assert [(r.ticker, r.headline) for r in got] == [("T", "Tea (T): hold, as no analyst covers it; 4 strategies name it.")]


def test_draws_are_checked_and_repeatable():
    drawn = strategies.draws(4)
    assert len(drawn) == 33 and drawn == strategies.draws(4) != strategies.draws(5)
    assert {name for name, _, _ in drawn} == set(strategies.STRATEGIES)
    for name, _, given in drawn:
        assert all(v in strategies.DRAWN[name][p] for p, v in given.items())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_a_run_is_persisted_and_read_back(spark, tmp_path):
    t = Tables(spark, FOLDER)
    n = strategies.persist_run(t, f"{tmp_path}/run")
    assert n == strategies.strategy_signals(t).count() == spark.read.parquet(f"{tmp_path}/run").count()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_kept_tables_are_derived_once(spark):
    t = Tables(spark, FOLDER)
    plan = lambda name: PLANS[name](t)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan("backtest_summary") + plan("inst_accumulation") + plan("conviction_facts")
    before = t.eod_prices
    assert t.eod_prices is before
    t.forget()
    assert t.eod_prices.inputFiles() != before.inputFiles() and t.eod_prices.count() == before.count()


def test_entry(spark):
    assert "ret_1d" in __spark_entry__.entry(spark).columns


def brute_growth(name, s):
    import numpy as np

    def ends(x):
        return (x[-1] / x[0]) ** (1 / (len(x) - 1)) - 1 if len(x) > 1 and x[0] > 0 and x[-1] > 0 else None

    steps = [(b / a - 1, k) for k, (a, b) in enumerate(zip(s, s[1:]), 1) if a > 0]
    return {
        "logfit_trend": lambda: float(np.exp(np.polyfit(range(len(s)), np.log(s), 1)[0]) - 1) if len(s) > 2 and min(s) > 0 else None,
        "cagr_5yr": lambda: ends(s[-6:]),
        "cagr_3yr": lambda: ends(s[-4:]),
        "mean_yoy": lambda: sum(g * k for g, k in steps) / sum(k for _, k in steps) if steps else None,
        "cagr_full": lambda: ends(s),
        "last_yoy": lambda: s[-1] / s[-2] - 1 if len(s) > 1 and s[-2] > 0 else None,
    }[name]()


def brute_method(s):
    errors = {}
    for name in ESTIMATORS:
        if brute_growth(name, s) is None:
            continue
        tried = []
        for h in range(1, min(3, len(s) - 2) + 1):
            g = brute_growth(name, s[:-h])
            if g is not None:
                guesses = [s[-h - 1] * (1 + g) ** (k + 1) for k in range(h)]
                each = [abs(a - p) / ((abs(a) + abs(p)) / 2) for a, p in zip(s[-h:], guesses) if abs(a) + abs(p) > 0]
                tried += [sum(each) / len(each)] if each else []
        errors[name] = (not tried, sum(tried) / len(tried) if tried else 0.0)
    return min(errors, key=lambda n: (errors[n][0], round(errors[n][1], 10), list(ESTIMATORS).index(n)), default=None)


def test_focus_forecast_against_brute_force(spark):
    import random

    r = random.Random(9)
    series = {str(k): [r.uniform(-1, 9) if k % 4 == 0 else r.uniform(1, 9) for _ in range(r.randint(3, 9))] for k in range(60)}
    got = {x.t: x for x in focus_forecast(spark.createDataFrame(list(series.items()), "t string, levels array<double>"), ["t"]).collect()}
    for t, s in series.items():
        want = brute_method(s)
        if want is None:
            assert t not in got
            continue
        assert got[t].method == want
        assert got[t].growth == pytest.approx(brute_growth(want, s))
        assert got[t].projected_level == pytest.approx(s[-1] * (1 + got[t].growth) ** 5)
