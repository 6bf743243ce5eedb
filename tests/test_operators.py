import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridia.functions.numbers import half_up, money, to_date, to_integer, to_number
from meridia.operators import upsert as up
from meridia.operators.latest import as_of_join, latest_by
from meridia.operators.ordered import average_ranks
from meridia.operators.stats import equal_bins, rank_correlation, winsorise, z_scores
from meridia.sources.ingest import SPECS, explode_dated, explode_options, ingest, split_ratio, ticker_parts, without_nan


def days(n):
    return date(2001, 1, 1) + timedelta(days=n)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("period", [None, "month"])
def test_as_of_join_against_brute_force(spark, exact, period):
    r = random.Random(4)
    data = [(r.choice("abc"), days(r.randint(0, 300)), float(k)) for k in range(60)]
    data = list({(k, d): (k, d, v) for k, d, v in data}.values()) + [("a", None, 5.0)]
    probes = [(r.choice("abcd"), days(r.randint(0, 320)), k) for k in range(80)]
    got = as_of_join(
        spark.createDataFrame(probes, "k string, at date, n int"), spark.createDataFrame(data, "k string, d date, v double"), ["k"], "at", "d", {"v": "v"}, at="found", exact=exact,
        period=F.trunc("_time", "MONTH") if period else None,
    )
    assert got.columns == ["k", "at", "n", "v", "found"]
    rows = got.collect()
    assert len(rows) == len(probes)
    for x in rows:
        known = [(d, v) for k, d, v in data if k == x.k and d and (d <= x.at if exact else d < x.at)]
        assert (x.found, x.v) == (max(known) if known else (None, None))


def test_latest_by(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "q")], "k string, d int, v string")
    assert [tuple(x) for x in latest_by(df, ["k"], ["d"]).collect()] == [("a", 3, "y")]


def test_ranks_bins_and_scores_against_pandas(spark):
    r = random.Random(1)
    rows = [(g, f"t{k:03d}", float(r.randint(0, 40)) if r.random() > 0.1 else None, r.gauss(0, 1)) for g in ("x", "y") for k in range(50)]
    df = spark.createDataFrame(rows, "g string, t string, v double, w double")
    got = average_ranks(z_scores(df, {"z": F.col("v")}, ["g"]), "v", ["g"], "rank").toPandas().sort_values(["g", "t"]).reset_index(drop=True)
    want = got.groupby("g").v
    assert np.allclose(got["rank"], want.rank(), equal_nan=True)
    assert np.allclose(got.z, (got.v - want.transform("mean")) / want.transform(lambda s: s.std(ddof=0)), equal_nan=True)
    ic = {x.g: x.ic for x in rank_correlation(df, "v", "w", ["g"]).collect()}
    for g, part in got.dropna(subset=["v"]).groupby("g"):
        assert math.isclose(ic[g], part.v.rank().corr(part.w.rank()), abs_tol=1e-12)
    held = winsorise(df, "w", ["g"]).toPandas()
    for g, part in got.groupby("g"):
        assert np.allclose(sorted(held[held.g == g].w), sorted(part.w.clip(part.w.quantile(0.01), part.w.quantile(0.99))))


@pytest.mark.parametrize("n", [30, 37, 100])
def test_equal_bins_are_those_of_pandas(spark, n):
    df = spark.createDataFrame([("x", k, float((k * 7) % n)) for k in range(n)], "g string, t int, v double")
    got = equal_bins(df, "v", "t", ["g"]).toPandas().sort_values("t")
    assert list(got.bin) == list(pd.qcut(got.v.rank(method="first"), 10, labels=False))


def test_constant_groups_have_no_score(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 1.0)], "g string, v double")
    assert [x.z for x in z_scores(df, {"z": F.col("v")}, ["g"]).collect()] == [None, None]


def test_upserts(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None)], "k int, v double, raw string")
    new = spark.createDataFrame([(2, 9.0, "n"), (3, None, "n"), (4, 4.0, None)], "k int, v double, raw string")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    assert rows(up.upsert(old, new, ["k"])) == [(1, 1.0, "a"), (2, 9.0, "n"), (3, None, "n"), (4, 4.0, None)]
    assert rows(up.upsert_partial(old, new, ["k"], ["raw"])) == [(1, 1.0, "a"), (2, None, "n"), (3, 3.0, "n"), (4, 4.0, None)]
    assert rows(up.coalescing_upsert(old, new, ["k"])) == [(1, 1.0, "a"), (2, 9.0, "n"), (3, 3.0, "n"), (4, 4.0, None)]
    assert rows(up.insert_ignore(old, new, ["k"])) == [(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None), (4, 4.0, None)]
    assert rows(up.enrich(old, new, ["k"], ["v"])) == [(1, 1.0, "a"), (2, 9.0, "b"), (3, 3.0, None)]


def test_replace_slice(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("d1", 1), ("d2", 2)], "d string, v int")
    assert up.replace_slice(first, path, "d") == 2
    assert up.replace_slice(spark.createDataFrame([("d2", 5), ("d2", 6)], "d string, v int"), path, "d") == 2
    assert sorted((x.d, x.v) for x in spark.read.parquet(path).collect()) == [("d1", 1), ("d2", 5), ("d2", 6)]


def test_replace_slice_evaluates_its_rows_once(spark, tmp_path):
    """Rows that are others each time they are evaluated."""
    chance = spark.range(50).selectExpr("'d1' as d", "rand() as v")
    assert up.replace_slice(chance, str(tmp_path / "t"), "d") == 50


def test_replace_slice_tells_when_other_rows_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(up, "_digest", lambda df, n=iter(range(9)): (next(n), 0))
    with pytest.raises(ValueError):
        up.replace_slice(spark.createDataFrame([("d1", 1)], "d string, v int"), str(tmp_path / "t"), "d")


def test_update_from_entries(spark):
    old = [("A", "x", date(2001, 1, 2), None, None), ("A", "y", date(2001, 1, 2), 1.0, 2.0), ("B", "x", date(2001, 1, 2), None, 9.0)]
    old = spark.createDataFrame(old, "ticker string, holder string, day date, change double, pct double")
    block = '{"Funds":{"0":{"name":"x","date":"2001-01-02","change":"5","change_p":"0.5"},"1":{"name":"y","date":"2001-01-02","change":7},"2":{"name":"x","date":"bad","change":8},"3":{"name":"z"}}}'
    blocks = spark.createDataFrame([("A", block), ("B", '{"Funds":[]}'), ("C", None)], "ticker string, holders string")
    got = up.update_from_entries(old, blocks, ["ticker", "holder", "day"], "holders", "Funds", {"change": "change", "pct": "change_p"}, {"holder": "name", "day": "date"})
    assert sorted((x.ticker, x.holder, x.change, x.pct) for x in got.collect()) == [("A", "x", 5.0, 0.5), ("A", "y", 1.0, 2.0), ("B", "x", None, 9.0)]


def test_workspace(spark, tmp_path):
    from meridia.sources import workspace

    table = workspace.written(spark.range(5), "five")
    assert table.count() == 5 and workspace.workspace(spark) in table.inputFiles()[0].removeprefix("file:").replace("///", "/")
    workspace.discard(table)
    assert not workspace.exists(spark, table.inputFiles()[0])
    spark.range(3).write.parquet(f"{tmp_path}/own")
    workspace.discard(spark.read.parquet(f"{tmp_path}/own"))  # not of the workspace, so it stays
    assert spark.read.parquet(f"{tmp_path}/own").count() == 3


def test_ingest_cleans_types_and_drops(spark):
    rows = [
        ('{"date":"2001-02-03","close":"12.5","volume":"7.9"}', "A.US", 1),
        ('{"date":"2001-02-03","close":"NaN","volume":"x"}', "A.US", 2),
        ('{"date":"0000-00-00","close":"1"}', "A.US", 3),
        ('{"close":"1"}', "A.US", 4),
        ("not json", "A.US", 5),
        (None, None, 6),
    ]
    got = ingest(spark.createDataFrame(rows, "payload string, ticker string, seen int"), SPECS["eod_prices"], order="seen").collect()
    assert [(x.ticker, x.date, x.close, x.volume) for x in got] == [("A.US", date(2001, 2, 3), None, None)]


def test_ingest_of_every_table_survives_empty_and_odd_payloads(spark):
    odd = spark.createDataFrame([('{"code":"X"}',), ("{}",), ("[]",), (None,)], "payload string")
    for spec in SPECS.values():
        for x in ingest(odd, spec).collect():
            assert all(x[k] is not None for k in spec.keys)


def test_nested_payloads(spark):
    text = '{"yearly":{"2000-12-31":{"date":"2000-12-31","totalRevenue":"5"}},"quarterly":{},"other":{"1":{"date":"2000-01-01"}}}'
    opened = explode_dated(spark.createDataFrame([("A", text)], "ticker string, payload string"), "payload", "yearly", "quarterly").withColumnRenamed("section", "period_type")
    assert [(x.ticker, x.date, x.total_revenue) for x in ingest(opened, SPECS["statements"]).collect()] == [("A", date(2000, 12, 31), 5.0)]


def test_option_chains_keep_each_snapshot_and_all_fields(spark):
    chain = '{"data":[{"expirationDate":"2024-03-15","options":{"CALL":[{"strike":10,"lastPrice":%s,"delta":0.5,"timeValue":1.5,"inTheMoney":true,"lastTradeDateTime":"2024-01-02T10:00:00Z"}],"PUT":[{"strike":10,"gamma":0.1},{"bid":1}]}},{"options":{"CALL":[{"strike":1}]}}]}'
    payloads = spark.createDataFrame([("A", chain % 2, "2024-01-02"), ("A", chain % 3, "2024-01-03"), ("A", "x", "2024-01-04")], "ticker string, payload string, snapshot_date string")
    got = {(x.option_type, x.snapshot_date.day): x for x in ingest(explode_options(payloads), SPECS["options_chains"]).collect()}
    assert sorted(got) == [("CALL", 2), ("CALL", 3), ("PUT", 2), ("PUT", 3)] and len(SPECS["options_chains"].columns) == 23
    x, y = got["CALL", 3], got["PUT", 2]
    assert (x.last, x.delta, x.time_value, x.in_the_money, x.last_trade_date is not None, x.expiration_date) == (3.0, 0.5, 1.5, True, True, date(2024, 3, 15))
    assert (y.gamma, y.in_the_money, y.last) == (0.1, False, None)


def test_fundamentals_and_earnings_payloads(spark):
    payload = lambda text: spark.createDataFrame([("A", text)], "ticker string, payload string")
    x = ingest(payload('{"General":{"Type":"Common Stock","IPODate":"2000-01-02","FullTimeEmployees":7},"Highlights":{"PERatio":"12.5"},"Valuation":{"a":1}}'), SPECS["fundamentals"]).first()
    assert (x.asset_type, x.ipo_date, x.full_time_employees, x.is_delisted, x.pe_ratio, x.eps) == ("Common Stock", date(2000, 1, 2), 7, False, 12.5, None)
    assert (x.valuation, x.components, len(x)) == ('{"a":1}', "{}", 1 + 36 + 15)
    x = ingest(payload('{"date":"2024-03-31","period":"0q","earningsEstimateLow":1,"earningsEstimateHigh":2,"revenueEstimateLow":3,"revenueEstimateHigh":4}'), SPECS["earnings_trend"]).first()
    assert (x.earnings_estimate_low, x.earnings_estimate_high, x.revenue_estimate_low, x.revenue_estimate_high) == (1.0, 2.0, 3.0, 4.0)
    x = ingest(payload('{"code":"B","report_date":"2024-04-01","actual":1,"estimate":2,"percent":-50}'), SPECS["earnings_calendar"]).first()
    assert (x.ticker, x.report_date, x.eps_actual, x.eps_estimate, x.surprise_pct) == ("B", date(2024, 4, 1), 1.0, 2.0, -50.0)


def test_run_all_goes_on_after_a_failure(spark):
    from meridia.sources.ingest import run_all

    def fails():
        raise RuntimeError("no answer")

    made, log = run_all({"one": lambda: spark.range(1), "two": fails, "three": lambda: spark.range(3)})
    assert sorted(made) == ["one", "three"] and log[1] == ("two", "failed", "RuntimeError: no answer")
    assert [x[1] for x in log] == ["ok", "failed", "ok"]


def test_the_last_payload_of_a_key_stands(spark):
    rows = [("A", '{"date":"2001-02-03","close":"9"}'), ("A", '{"date":"2001-02-03","close":"2"}')]
    got = ingest(spark.createDataFrame(rows, "ticker string, payload string").coalesce(1), SPECS["eod_prices"]).first()
    assert got.close == 2.0


def test_scalars(spark):
    df = spark.createDataFrame([("2001-02-03T10:00", "1e3", "-7.9"), ("N/A", "inf", ""), ("2001-02-30", "abc", None)], "a string, b string, c string")
    got = [tuple(x) for x in df.select(to_date(F.col("a")), to_number(F.col("b")), to_integer(F.col("c"))).collect()]
    assert got == [(date(2001, 2, 3), 1000.0, -7), (None, None, None), (None, None, None)]
    one = spark.range(1)
    x = one.select(*split_ratio(F.lit("4/1")), *ticker_parts(F.lit("BRK.B.US")), *ticker_parts(F.lit("X")), money(F.lit(2.34e9)), money(F.lit(-12.0)), half_up(F.lit(2.345), 2)).first()
    assert tuple(x) == (4.0, 1.0, "BRK.B", "US", None, None, "$2.3B", "-$12", 2.35)
    assert [x.v for x in without_nan(spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),)], "v double")).collect()] == [None, 1.0, None]


def test_streams(spark, tmp_path):
    from meridia.streaming.quotes import current, daily_bars, first_seen, latest_quotes, versions

    rows = [("A", datetime(2001, 1, 1, 10), 5.0, 1), ("A", datetime(2001, 1, 1, 12), 7.0, 2), ("B", datetime(2001, 1, 1, 9), 3.0, 1), ("A", datetime(2001, 1, 4, 9), 1.0, 1)]
    schema = "ticker string, ts timestamp, price double, volume int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/q")
    source = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/q")
    q = daily_bars(source()).writeStream.format("memory").queryName("bars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    bars = {x.ticker: x for x in spark.sql("select * from bars where date = date '2001-01-01'").collect()}
    assert (bars["A"].open, bars["A"].high, bars["A"].close, bars["A"].volume) == (5.0, 7.0, 7.0, 3)
    assert current(spark, f"{tmp_path}/none") is None
    q = latest_quotes(source(), f"{tmp_path}/latest", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {x.ticker: x.price for x in current(spark, f"{tmp_path}/latest").collect()} == {"A": 1.0, "B": 3.0}
    # a late batch changes nothing, nor does one that runs again; what no reader is at any more goes
    spark.createDataFrame([("A", datetime(2001, 1, 2), 9.0, 1), ("B", datetime(2001, 1, 2), 4.0, 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
    for _ in range(2):
        q = latest_quotes(source(), f"{tmp_path}/latest", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        assert {x.ticker: x.price for x in current(spark, f"{tmp_path}/latest").collect()} == {"A": 1.0, "B": 4.0}
        for f in (tmp_path / "cp" / "commits").glob("*1*"):
            f.unlink()
    assert versions(spark, f"{tmp_path}/latest") == [0, 1]
    q = first_seen(source(), key="ticker", time="ts").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from seen").first()[0] == 2


def test_sinks(spark, tmp_path):
    from meridia.sources import store

    df = spark.createDataFrame([("A", float("nan"), date(2001, 1, 2)), ("B", 2.0, None)], "k string, v double, d date")
    store.write_csv(df, f"{tmp_path}/c")
    assert sorted(x.k for x in spark.read.csv(f"{tmp_path}/c", header=True).collect()) == ["A", "B"]
    store.write_json(df, str(tmp_path / "j"), "one")
    store.write_json(df.where("k = 'B'"), str(tmp_path / "j"), "two")
    assert [x.v for x in store.read_latest(spark, str(tmp_path / "j")).collect()] == [2.0]
    for _ in range(2):
        store.log_ingest(spark, f"{tmp_path}/log", "eod", "2001-01-02 03:04:05", "ok", 5)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    assert store.validate_schema({"t": df}, {"t": ["k", "x"], "u": ["y"]}) == ["u", "t.x"]
    assert store.distinct_values(df, "k") == ["A", "B"]


def test_parameter_gate():
    from meridia.plans.strategies import checked

    allowed = {"days": [], "benchmark": ["SPY.US"]}
    assert checked({"days": 30, "benchmark": "SPY.US"}, allowed) == {"days": 30, "benchmark": "SPY.US"}
    for bad in ({"days": True}, {"x": 1}, {"benchmark": "QQQ"}, {"days": "30; drop table t"}, {"days": None}):
        with pytest.raises(ValueError):
            checked(bad, allowed)


def test_rank_correlation_of_values_that_come_out_otherwise_when_evaluated_again(spark):
    """A mean of doubles depends on the order of its blocks; ranks must still find the value that they were made for."""
    noisy = F.udf(lambda k: k + random.random() / 2, "double").asNondeterministic()
    df = spark.range(40).select(F.lit("g").alias("g"), "id", noisy("id").alias("m"))
    (row,) = rank_correlation(df, "id", "m", ["g"]).collect()
    assert (row.n, row.ic) == (40, pytest.approx(1.0))
