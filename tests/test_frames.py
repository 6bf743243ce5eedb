"""Frames in blocks against plain windows, and the latest rows as of a time against a search."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.operators.frames import Source, in_blocks, latest_as_of

D0 = datetime.date(2000, 1, 1)
day = lambda n: D0 + datetime.timedelta(n)


@pytest.fixture(scope="module")
def prices(spark):
    """A long history with gaps of years, a short one, one of a single row, and one of a null key."""
    r = random.Random(2)
    rows = [("long", day(d), float(d % 97)) for d in r.sample(range(3000), 700)] + [("one", day(5), 1.0)]
    rows += [(k, day(d * 40), float(d)) for k in ("short", None) for d in range(12)]
    return spark.createDataFrame(rows, "ticker string, date date, close double").repartition(5)


@pytest.mark.parametrize(("back", "ahead", "block"), [(19, 0, 19), (30, 2, 64), (3, 7, 7), (200, 1, 100_000)])
def test_frames_in_blocks_are_plain_windows(prices, back, ahead, block):
    frames = {
        "total": lambda w: F.sum("close").over(w.rowsBetween(-back, ahead)),
        "n": lambda w: F.count("*").over(w.rowsBetween(-back, -1)),
        "before": lambda w: F.lag("close", back).over(w),
    } | ({"next": lambda w: F.lead("date", ahead).over(w)} if ahead else {})
    got = in_blocks(prices, ["ticker"], "date", frames, back, ahead, block)
    plain = Window.partitionBy("ticker").orderBy("date")
    want = prices.withColumns({name: f(plain) for name, f in frames.items()})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    by_month = in_blocks(prices, ["ticker"], "date", frames, back, ahead, block, period=F.trunc("date", "MONTH"))
    assert sorted(map(str, by_month.collect())) == sorted(map(str, want.collect()))


def test_a_block_holds_its_frames(prices):
    with pytest.raises(ValueError, match="block"):
        in_blocks(prices, ["ticker"], "date", {}, back=10, block=9)


@pytest.mark.parametrize("k", [1, 2, 4])
def test_latest_rows_of_several_sources(spark, k):
    """Late, early, repeated and never known rows; the order of what is known is not the order of when."""
    r = random.Random(k)
    of = lambda n: [(r.choice(["a", "b", None]), day(r.randint(0, 60)), r.choice([None, *[day(r.randint(0, 90)) for _ in range(6)]]), r.randint(0, 9)) for _ in range(n)]
    data = {"income": of(60), "cash": of(25), "none": []}
    probes = [(t, day(d)) for t in ("a", "b", "c", None) for d in range(0, 95, 6)] + [("a", day(12))]
    table = lambda rows: spark.createDataFrame(rows, "ticker string, date date, known date, v int").repartition(3)
    sources = {n: Source(table(rows), "known", "date", ["v"]) for n, rows in data.items()}
    got = latest_as_of(spark.createDataFrame(probes, "ticker string, at date"), sources, ["ticker"], "at", k)
    shown = lambda rows: [(x.date, x.v) for x in rows]
    found = sorted(((x.ticker, x["at"], *[shown(x[n]) for n in data]) for x in got.collect()), key=str)
    latest = lambda rows, t, at: sorted(((d, v) for key, d, known, v in rows if key == t and known and known <= at), reverse=True)[:k]
    assert found == sorted(((t, at, *[latest(rows, t, at) for rows in data.values()]) for t, at in probes), key=str)


def test_latest_rows_take_one_shuffle_of_the_probes(spark):
    rows = spark.createDataFrame([("a", D0, D0, 1)], "ticker string, date date, known date, v int")
    got = latest_as_of(rows.select("ticker", F.col("date").alias("at")), {"x": Source(rows, "known", "date", ["v"])}, ["ticker"], "at", 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
