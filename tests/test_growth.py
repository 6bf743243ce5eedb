"""What a plan derives and keeps: facts are passed over once for each rollup, and wide tables only as far as they are asked for."""

import os
from datetime import date

import pytest

from meridia.plans import payloads, strategies
from meridia.plans.catalog import PLANS
from meridia.sources import domain
from meridia.sources.domain import Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def names_kept(spark, plan):
    """What a plan keeps, itself included, when nothing was kept before."""
    t = Tables(spark, FOLDER)
    t.forget()
    PLANS[plan](t)
    return {name for app, folder, name in domain._WRITTEN if app == spark.sparkContext.applicationId and folder == FOLDER}


@pytest.mark.parametrize("plan", ["prices_asof", "benchmark_return"])
def test_prices_at_the_dates_keep_no_wide_table(spark, plan):
    assert names_kept(spark, plan) == {"probed_prices"}


def test_interaction_diagnostic_reads_its_signals_as_they_were_kept(spark):
    assert {"bt_value", "bt_piotroski", "known_statements"} <= names_kept(spark, "interaction_diagnostic")


def test_a_run_is_a_union_of_written_rows(spark):
    """A union of limits runs as one task, with the memory of every plan in it."""
    plan = strategies.run_of(Tables(spark, FOLDER), strategies.RUN_SEED)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Join" not in plan


def test_positions_are_kept_for_all_that_read_them(spark):
    assert "positions_365" in names_kept(spark, "smart_institution_holdings")


def test_both_kinds_of_holders_come_from_one_pass_over_the_facts(spark):
    assert "moves" in names_kept(spark, "inst_flow") & names_kept(spark, "fund_flow")


def test_holders_of_one_name_are_added_up_by_their_last_period(spark, tmp_path):
    """Two suppliers share a name: one filed last in March, the other in May and June; a third is alone in its name."""
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date"
    sold = [(1, "N", 5.0, "2001-03-02"), (1, "R", 2.0, "2001-01-09"), (2, "N", 7.25, "2001-05-03"), (2, "N", 1.0, "2001-06-01"), (2, "R", 3.0, "2001-06-30"), (2, "N", 9.0, "2001-07-01"), (3, "N", 4.0, "2001-06-15")]
    rows = [(k, 1, s, flag, q, q, 0.0, 0.0, date.fromisoformat(d)) for k, (s, flag, q, d) in enumerate(sold)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#1")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "same", 0), (2, "same", 0), (3, "other", 0)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "land")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    t = Tables(spark, str(tmp_path))
    held = lambda df: {r.holder_name: (str(r.report_date), r.shares_held, r.change_shares) for r in df.collect()}
    assert held(t.institutional_holders) == {"same": ("2001-06-30", 8250.0, 5250.0), "other": ("2001-06-30", 4000.0, 4000.0)}
    assert held(t.fund_holders)["land"] == ("2001-06-30", 12250.0, None if len("land") % 5 == 4 else 2000.0)


def test_payloads_are_put_together_without_a_broadcast(spark):
    """Joined part by part, a ticker's holders were taken for a small table and sent whole to the driver."""
    t = Tables(spark, FOLDER)
    plan = payloads.fundamentals_payloads(t)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_moves_are_not_sent_to_the_driver(spark):
    """They grow with the facts; the names that they meet grow with the suppliers."""
    t = Tables(spark, FOLDER)
    t.forget()
    seen = []
    before, domain.written = domain.written, lambda df, name, **k: seen.append((name, df._jdf.queryExecution().executedPlan().toString())) or before(df, name, **k)
    try:
        t.institutional_holders
    finally:
        domain.written = before
    assert "SortMergeJoin" in dict(seen)["held"]


def test_holders_with_their_prices_are_not_sent_to_the_driver(spark):
    plan = strategies._priced_positions(Tables(spark, FOLDER), 365)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_suppliers_are_grouped_by_so_many_rows_a_task(spark, monkeypatch):
    """Merged into a task a core, the groups outgrew a task's memory as the facts grew, and were spilled at each step."""
    t = Tables(spark, FOLDER)
    t.forget()
    n = t.read("lineitem").count()
    seen = []
    monkeypatch.setattr(domain, "ROWS", 1000)
    monkeypatch.setattr(domain, "written", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    t.moves
    t.forget()
    assert f"{-(-n // 1000)}), REPARTITION_BY_NUM" in seen[0]


def test_amounts_are_added_up_exactly_and_mostly_as_whole_numbers(spark, tmp_path):
    """Values with more digits, large ones and nulls give what decimals alone give."""
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date"
    odd = [0.07, 1.005, 0.005, -0.015, 1.15, 0.29, 999999.99, 1e6, 1000000.01, 123456789012.34, -3.0, 0.1 + 0.2, None]
    rows = []
    for k, (q, x) in enumerate((q, x) for q in odd for x in odd):
        rows.append((k, 1, k % 3 + 1, "NRA"[k % 3], q, x, (0.05, 0.105, None, 1.0)[k % 4], (0.08, 0.0, 0.015)[k % 3], date(2001, 1 + k % 5, 3)))
    rows.append((999, 1, 9, "N", None, None, None, None, date(2001, 6, 1)))
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#1")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    t = Tables(spark, str(tmp_path))
    by = ["ticker", "date", "l_returnflag"]
    sums = {c: "sum" for c in ("n", "q", "x", "net", "taxed")}
    want = t.measured.groupBy(*by).agg(sums | {"top": "max", "bottom": "min"})
    want = want.select(*by, *[want[f"sum({c})"].alias(c) for c in sums], want["max(top)"].alias("top"), want["min(bottom)"].alias("bottom"))
    assert t.daily.dtypes == want.dtypes
    key = lambda r: str(r[:3])
    assert sorted(t.daily.collect(), key=key) == sorted(want.collect(), key=key)
    q = t.lines.selectExpr("l_suppkey", "cast(if(l_returnflag = 'R', -q, q) * 1000 as bigint) m").groupBy("l_suppkey").sum("m")
    assert sorted((r.l_suppkey, r.moved) for r in t.moves.collect()) == sorted(tuple(r) for r in q.collect())
    plan = t.lines.where(domain.plain("l_quantity")).select(domain.hundredths("l_quantity").alias("h"), "q")
    assert plan.count() and all(r.h == int(r.q * 100) for r in plan.collect())


def folder_of(spark, path, rows, parts):
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date"
    spark.createDataFrame([(k, *r[:4], r[3], 0.05, 0.02, date.fromisoformat(r[4])) for k, r in enumerate(rows)], line).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{path}/part.parquet")
    return Tables(spark, str(path))


def test_last_months_and_quarters_come_from_one_shuffle_read_twice(spark, tmp_path, monkeypatch):
    """Grouped by quarter first, most groups had one row. A part without a brand, whose shares count for a holder's book, and one whose brand is empty stay apart."""
    rows = [(1, 1, "N", 5.0, "2000-12-31"), (1, 1, "N", 2.0, "2001-01-01"), (1, 1, "R", 1.0, "2001-01-31"), (1, 1, "N", 4.0, "2001-03-31"), (1, 1, "N", None, "2001-03-01"), (1, 2, "N", None, "2000-05-01")]
    rows += [(2, 1, "N", 7.0, "2001-02-01"), (3, 1, "N", 9.0, "2001-06-30"), (3, 1, "N", 1.0, "2001-04-01"), (1, None, "N", 3.0, "2001-04-01"), (1, 1, "N", 8.0, "2001-07-01")]
    t = folder_of(spark, tmp_path, rows, [(1, "Brand#1"), (2, None), (3, "")])
    monkeypatch.setattr(domain, "written", lambda df, name: df)
    moves = t.moves
    got = {(r.ticker, r.l_suppkey): (r.moved, str(r.quarter), r.in_quarter, str(r.month), r.in_month) for r in moves.collect()}
    assert got == {
        ("Brand#1", 1): (10000, "2001-03-31", 5000, "2001-03-31", 4000),
        ("Brand#1", 2): (None, "2000-06-30", None, "2000-05-31", None),
        (None, 1): (7000, "2001-03-31", 7000, "2001-02-28", 7000),
        ("", 1): (10000, "2001-06-30", 10000, "2001-06-30", 9000),
    }
    plan = moves._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_no_wide_decimal_is_added_up_for_each_line_item(spark, tmp_path, monkeypatch):
    """A sum of wide decimals, though of nulls, made objects for every row; now they come after the rows were combined."""
    t = folder_of(spark, tmp_path, [(1, 1, "N", 5.0, "2001-01-01"), (1, 1, "N", 1e7, "2001-01-01"), (1, 1, "N", 1e7, "2001-01-01")], [(1, "Brand#1")])
    monkeypatch.setattr(domain, "written", lambda df, name: df)
    found = t.daily
    assert [(r.n, str(r.q), str(r.net)) for r in found.collect()] == [(3, "20000005.00", "19000004.7500")]
    lowest = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "HashAggregate" in x][-1]
    assert "sum" in lowest and "decimal" not in lowest


def test_holdings_have_one_row_a_holder_and_ticker(spark):
    """So the last filing of each needs no grouping, which sorted all holders."""
    t = Tables(spark, FOLDER)
    rows = t.institutional_holders.groupBy("ticker", "holder_name").count()
    assert rows.where("count > 1").count() == 0 and rows.count() > 0
    assert "Aggregate [holder_name" not in strategies._priced_positions(t, 365)._jdf.queryExecution().optimizedPlan().toString()


def test_only_owners_who_buy_or_sell_are_grouped(spark):
    rows = [("T", date(2024, 1, 20), o, r, c) for o, r, c in [("a", "x", "P"), ("a", "y", "P"), ("b", "x", "S"), ("c", "x", "A"), ("d", "x", "A"), (None, "x", "P")]] + [("T", date(2024, 1, 29), "e", "x", "A")]
    t = Tables(spark, FOLDER)
    t.insider_transactions = spark.createDataFrame(rows, "ticker string, transaction_date date, owner_name string, relationship string, transaction_code string")
    got = strategies._insiders(t, 30)
    r = got.first()
    assert (r.buyers, r.sellers, r.buy_trades, r.sell_trades, r.buyer_names, r.seller_names, str(r.latest_activity)) == (1, 1, 3, 1, "a", "b", "2024-01-29")
    assert "relationship" not in got._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_the_configured_benchmarks_need_no_python_worker(spark):
    from meridia.plans.newsletter import index_overview

    plan = index_overview(Tables(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "ExistingRDD" not in plan
