"""Stored tables: touched slices alone are rewritten, lists are atomic, views outlast the application, banks keep intervals."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from meridia.operators.upsert import insert_ignore, upsert
from meridia.plans.stored import PriceView, VintageBank
from meridia.sources import domain
from meridia.sources.stored import StoredTable, by_bucket, by_month

D = datetime.date
SCHEMA = "ticker string, date date, close double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, path, slice_of=None):
    return StoredTable(spark, str(path), by_month("date") if slice_of is None else slice_of)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/versions/**/*.parquet", recursive=True)}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


OLD = [("a", D(2001, 1, 5), 1.0), ("b", D(2001, 1, 6), 2.0), ("a", D(2001, 2, 1), 3.0), ("c", None, 4.0)]


def test_a_merge_rewrites_only_the_slices_it_touches(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.replace(frame(spark, OLD)) == ["2001-01", "2001-02", "null"]
    before = files(tmp_path)
    new = [("a", D(2001, 2, 1), 9.0), ("d", D(2001, 3, 1), 5.0), ("d", D(2001, 3, 1), 6.0)]
    assert t.merge(frame(spark, new), lambda old, rows: upsert(old, rows, ["ticker", "date"])) == ["2001-02", "2001-03"]
    assert rows_of(t.read()) == rows_of(frame(spark, [*OLD[:2], OLD[3], new[0], new[2]]))
    assert {f: m for f, m in files(tmp_path).items() if f in before} == before
    opened = {os.path.dirname(f).rsplit("=", 1)[-1] for f in t.read(["2001-01"]).inputFiles()}
    assert opened == {"2001-01"} and t.slices() == ["2001-01", "2001-02", "2001-03", "null"]
    assert {f.rsplit("versions/", 1)[-1] for f in t.read(["2001-01", "null"]).inputFiles()} <= {f.rsplit("versions/", 1)[-1] for f in before}


def test_nothing_changes_without_rows_and_appends_keep_files(spark, tmp_path):
    t = table(spark, tmp_path, by_bucket(["ticker"], 4))
    t.append(frame(spark, OLD))
    before = files(tmp_path)
    assert t.merge(frame(spark, []), lambda old, rows: upsert(old, rows, ["ticker", "date"])) == []
    assert files(tmp_path) == before and len(t._lists()) == 1
    t.append(frame(spark, OLD[:1]))
    assert set(before) < set(files(tmp_path)) and rows_of(t.read()) == rows_of(frame(spark, OLD + OLD[:1]))
    assert rows_of(t.read(number=1)) == rows_of(frame(spark, OLD))
    ignored = [("a", D(2001, 1, 5), 7.0)]
    t.merge(frame(spark, ignored), lambda old, rows: insert_ignore(old, rows, ["ticker", "date"]))
    assert rows_of(t.read()) == rows_of(frame(spark, OLD + OLD[:1]))


def test_a_write_is_seen_whole_or_not_at_all(spark, tmp_path):
    t = table(spark, tmp_path)
    t.replace(frame(spark, OLD))
    with pytest.raises(Exception, match="boom"):
        t.merge(frame(spark, OLD), lambda old, rows: rows.withColumn("close", F.raise_error(F.lit("boom")).cast("double")))
    assert rows_of(t.read()) == rows_of(frame(spark, OLD))
    behind = t._list()
    t.replace(frame(spark, [("z", D(2001, 1, 1), 0.0)]))
    with pytest.raises(RuntimeError, match="another write was first"):
        t._publish(behind, frame(spark, []).schema, {})
    assert rows_of(t.read(["2001-01"])) == [("z", D(2001, 1, 1), 0.0)]
    t.replace(frame(spark, [("y", D(2001, 1, 1), 0.0)]))
    held = rows_of(t.read())
    assert t.forget_older(1) >= 1 and rows_of(t.read()) == held and len(t._lists()) == 1


def test_an_empty_table(spark, tmp_path):
    t = table(spark, tmp_path)
    assert not t.exists()
    with pytest.raises(ValueError, match="nothing has been stored"):
        t.read()
    t.replace(frame(spark, []))
    assert t.exists() and t.read().collect() == [] and t.read().columns == ["ticker", "date", "close"]


def test_prices_by_partial_sums(spark, tmp_path):
    """A day added touches its month; the sums are those of all lines."""
    lines = spark.range(600).selectExpr(
        "concat('t', id % 3) as ticker", "date_add(date'2001-01-01', cast(id % 90 as int)) as date", "cast(id * 1.25 as decimal(18,2)) as x",
        "cast(1 + id % 7 as decimal(18,2)) as q", "id * 1.25 / (1 + id % 7) as unit",
    )
    view, whole = PriceView(spark, f"{tmp_path}/a"), PriceView(spark, f"{tmp_path}/b")
    assert view.add(lines.where("date < date'2001-03-20'")) == ["2001-01", "2001-02", "2001-03"]
    before = files(f"{tmp_path}/a")
    for day in range(20, 32):
        assert view.add(lines.where(f"date = date'2001-03-{day}'")) == ["2001-03"]
    assert all("2001-03" in f for f in set(files(f"{tmp_path}/a")) - set(before))
    whole.add(lines)
    assert rows_of(view.prices()) == rows_of(whole.prices())
    assert rows_of(view.prices(["2001-02"])) == rows_of(whole.prices().where("month(date) = 2"))


def test_kept_tables_outlast_the_application(spark, tmp_path):
    """Where a folder for views is set, an application that has kept nothing yet reads what another left; changed sources are derived anew."""
    source = tmp_path / "in"
    spark.range(3).write.parquet(f"{source}/x.parquet")
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(f"{source}/x.parquet").selectExpr("id * 2 as v")

    spark.conf.set(domain.VIEWS_DIR, str(tmp_path / "views"))
    try:
        for _ in range(2):
            domain._WRITTEN.clear()
            assert rows_of(domain.Tables(spark, str(source)).keep("twice", make)) == [(0,), (2,), (4,)]
        assert len(made) == 1
        spark.range(3, 4).write.mode("append").parquet(f"{source}/x.parquet")
        domain._WRITTEN.clear()
        assert rows_of(domain.Tables(spark, str(source)).keep("twice", make)) == [(0,), (2,), (4,), (6,)]
        domain.Tables(spark, str(source)).forget()
        domain.Tables(spark, str(source)).keep("twice", make)
        assert len(made) == 3
    finally:
        spark.conf.unset(domain.VIEWS_DIR)


def test_the_bank_keeps_one_vintage_a_day_and_intervals(spark, tmp_path):
    bank = VintageBank(spark, str(tmp_path), ["v"], buckets=2)
    day = lambda d: D(2001, 1, d)
    rows = lambda **v: spark.createDataFrame([(k, x, "note") for k, x in v.items()], "ticker string, v double, note string")
    bank.bank(rows(a=1.0, b=None), "2001-01-01")
    bank.bank(rows(a=1.0, b=None, c=3.0), "2001-01-02")
    bank.bank(rows(a=2.0, b=5.0), "2001-01-03")
    bank.bank(rows(a=9.0, b=9.0, c=4.0), "2001-01-03")
    bank.bank(rows(a=7.0), "2001-01-02")
    want = [("a", 1.0, 1, 3), ("a", 2.0, 3, None), ("b", None, 1, 3), ("b", 5.0, 3, None), ("c", 3.0, 2, 3), ("c", 4.0, 3, None)]
    got = bank.vintages().select("ticker", "v", "valid_from", "valid_to")
    assert rows_of(got) == sorted([(k, v, day(f), t and day(t)) for k, v, f, t in want], key=str)
    assert rows_of(bank.as_of(F.lit("2001-01-02").cast("date")).select("ticker", "v")) == [("a", 1.0), ("b", None), ("c", 3.0)]
    assert rows_of(bank.as_of(F.lit("2000-01-01").cast("date"))) == []
