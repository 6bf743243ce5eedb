"""Audited runs, the landing zone, JSON blocks as tables, and table functions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from meridia.operators.variants import block_table
from meridia.plans import functions, reference_data
from meridia.sources.audit import IngestAudit, Step
from meridia.sources.domain import Tables
from meridia.sources.landing import Landing, Target
from meridia.sources.stored import StoredTable, by_bucket, by_month


def test_a_failing_step_leaves_its_row_and_others_go_on(spark, tmp_path):
    audit = IngestAudit(spark, f"{tmp_path}/log")
    table = StoredTable(spark, f"{tmp_path}/t", by_bucket(["id"], 2))
    steps = {
        "one": Step(lambda: spark.range(7), table.append),
        "two": Step(lambda: spark.range(3).select(F.raise_error(F.lit("no answer")).cast("long").alias("id")), table.append),
        "three": Step(lambda: 1 / 0),
        "four": Step(lambda: spark.range(0)),
    }
    assert audit.run_all(steps) == {"one": 7, "two": None, "three": None, "four": 0}
    runs = {r.endpoint: r for r in audit.runs().collect()}
    assert {e: (r.status, r.rows_written) for e, r in runs.items()} == {"one": ("ok", 7), "two": ("failed", None), "three": ("failed", None), "four": ("ok", 0)}
    assert "no answer" in runs["two"].error_message and "division by zero" in runs["three"].error_message
    assert all(r.started_at <= r.finished_at for r in runs.values()) and table.read().count() == 7
    audit.start("died")
    died = audit.runs().where("endpoint = 'died'").first()
    assert (died.status, died.finished_at) == ("running", None)
    assert audit.run("one", Step(lambda: spark.range(2), table.append)) == 2 and audit.runs().count() == 6


def lines(folder, name, *rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in rows)


def price(day, close, ticker="a"):
    return {"endpoint": "eod", "ticker": ticker, "payload": json.dumps({"date": day, "close": close})}


def test_files_are_taken_in_once_and_a_lost_run_is_repeated(spark, tmp_path):
    zone = f"{tmp_path}/zone"
    table = StoredTable(spark, f"{tmp_path}/eod", by_month("date"))
    seen, lost = [], [True]

    class Counted(Landing):
        def _batch(self, rows, number):
            seen.append(rows.count())
            super()._batch(rows, number)
            if lost[0]:
                raise RuntimeError("the driver is lost after the batch is merged")

    landing = Counted(spark, zone, f"{tmp_path}/state", {"eod": Target("eod_prices", table)})
    bad = ["no json", {"endpoint": "unknown", "payload": "{}"}, {"endpoint": "eod", "ticker": "a", "payload": '{"close": 3}'}, {"endpoint": "eod"}]
    lines(zone, "1.json", price("2001-01-02", 1), price("2001-01-03", 2), *bad)
    with pytest.raises(Exception, match="lost after the batch"):
        landing.take()
    lost[0] = False
    landing.take()
    assert seen == [6, 6]
    rows = lambda: sorted((r.ticker, str(r.date), r.close) for r in table.read().collect())
    assert rows() == [("a", "2001-01-02", 1.0), ("a", "2001-01-03", 2.0)]
    reasons = sorted(r.reason for r in landing.malformed.read().collect())
    assert reasons == ["no endpoint and payload"] * 3 + ["no key fields"]
    landing.take()
    assert seen == [6, 6]
    lines(f"{zone}/later", "2.json", price("2001-01-03", 5), price("2001-02-01", 6, "b"))
    landing.take()
    assert seen == [6, 6, 2] and rows() == [("a", "2001-01-02", 1.0), ("a", "2001-01-03", 5.0), ("b", "2001-02-01", 6.0)]
    assert landing.malformed.read().count() == 4


def test_blocks_keep_types_and_nesting(spark):
    texts = ['{"a":1,"b":"x","c":[1,2],"d":{"e":null},"n":null,"t":"' + "y" * 300 + '"}', '[{"k":1.5},{"k":"t","m":true},7]', "bad", None, "3", "{}", "[]", ""]
    rows = block_table(spark.createDataFrame(list(enumerate(texts)), "id int, j string"), "j", ["id"]).collect()
    got = sorted(map(tuple, rows), key=str)
    want = [
        (0, 0, "a", "1", "BIGINT"), (0, 0, "b", "x", "STRING"), (0, 0, "c", "[1,2]", "ARRAY<BIGINT>"), (0, 0, "d", '{"e":null}', "OBJECT<e: VOID>"), (0, 0, "n", None, None),
        (0, 0, "t", "y" * 200, "STRING"), (1, 0, "k", "1.5", "DECIMAL(2,1)"), (1, 1, "k", "t", "STRING"), (1, 1, "m", "true", "BOOLEAN"), (1, 2, None, "7", "BIGINT"),
    ]
    assert got == sorted(want, key=str)


def test_functions_check_their_parameters(spark):
    functions.register(Tables(spark, "/root/testdata/sf0.001"))
    of = lambda sql, **args: spark.sql(sql, args=args).collect()
    assert len(of("SELECT * FROM price_perf_at(CAST(:d AS DATE))", d="2001-06-30")) > 5
    few = of("SELECT * FROM prices_between(until => DATE'1995-01-01', symbol => :s)", s="Brand#11")
    assert all(r.ticker == "Brand#11" and r.date.year < 1996 for r in few)
    with pytest.raises(Exception, match="symbol must be given"):
        of("SELECT * FROM prices_between(symbol => CAST(:s AS STRING))", s=None)
    joined = "SELECT p.ticker FROM momentum_leaders(DATE'2001-06-30') p JOIN vintages_at(DATE'2001-06-30') v ON v.ticker = p.ticker"
    assert {r.ticker for r in of(joined)} <= {r.ticker for r in of("SELECT * FROM price_perf_at(DATE'2001-06-30')")}


def test_resolving_tickers(spark):
    symbols = [("ABC.US", "ABC", "Alpha Beta Corp"), ("ABCD.US", "ABCD", "Gamma"), ("AB.LSE", "AB", "alphabet  soup"), ("X.US", "X", None), ("Y.US", None, "beta")]
    queries = ["abc", " ab ", "AB", "alpha", "BETA", "brk.b", "a b.c", "", "  ", None, "zzz", "abcde", "gam", "lph"]
    got = reference_data.resolve_tickers(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(symbols, "ticker string, code string, name string"))
    want = {"abc": "ABC.US", " ab ": "AB.LSE", "AB": "AB.LSE", "alpha": "AB.LSE", "BETA": "Y.US", "brk.b": "BRK.B", "gam": "ABCD.US"}
    assert {r.query: r.ticker for r in got.collect()} == {q: want.get(q) for q in queries}


def test_making_sure_of_symbols(spark, tmp_path):
    symbols, exchanges = (StoredTable(spark, f"{tmp_path}/{n}", by_bucket([k], 2)) for n, k in (("s", "ticker"), ("e", "code")))
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "ticker string")
    symbols.replace(spark.createDataFrame([("A.US", "A", "US", False)], "ticker string, code string, exchange_code string, is_active boolean"))
    reference_data.ensure_symbols(of("A.US", "B.X.TO", "B.X.TO"), symbols, exchanges)
    want = [("A.US", "A", "US", False), ("B.X.TO", "B.X", "TO", True)]
    assert sorted(map(tuple, symbols.read().collect())) == want and sorted(r.code for r in exchanges.read().collect()) == ["TO", "US"]
    for bad in ("NODOT", None):
        with pytest.raises(ValueError, match="must look like CODE.EXCHANGE"):
            reference_data.ensure_symbols(of("C.US", bad), symbols, exchanges)
    assert sorted(map(tuple, symbols.read().collect())) == want
