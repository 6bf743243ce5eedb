"""Ordered passes against windows and percentile(), with ties, nulls, groups of one and one group of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.operators import ordered
from meridia.operators.ordered import average_ranks, bin_of, percentiles, placed, tile


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    made = []
    for k in range(900):
        group = r.choice([None, 1, 2, 2, 2, 2])
        made.append((group, k, r.choice([None, 1.5, -2.0, float(r.randint(0, 30)), r.gauss(0, 1e9), float("inf")]), "no"))
    made += [(9, 5000, 3.0, "no"), (8, 5001, None, "no")]
    return spark.createDataFrame(made, "g int, k long, v double, _of_other string").repartition(6)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize(("by", "partitions"), [([], 7), (["g"], 7), (["g"], 1)])
def test_places_tiles_and_bins(rows, by, partitions):
    got = placed(rows, [F.col("v").desc_nulls_last(), F.col("k").asc()], by, partitions)
    ordered_ = Window.partitionBy(*by).orderBy(F.col("v").desc_nulls_last(), "k")
    n = F.count("*").over(Window.partitionBy(*by))
    want = rows.select("g", "k", F.row_number().over(ordered_).cast("long").alias("p"), n.alias("n"), *[F.ntile(t).over(ordered_).alias(f"t{t}") for t in (1, 7, 100)])
    same(got.select("g", "k", F.col("_place").alias("p"), F.col("_n").alias("n"), *[tile(t).alias(f"t{t}") for t in (1, 7, 100)]), want)
    assert {r[0] for r in got.select(bin_of(10)).distinct().collect()} == set(range(10))


@pytest.mark.parametrize("partitions", [5])
def test_average_ranks(rows, partitions):
    w = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_last())
    rank = F.when(F.col("v").isNotNull(), F.rank().over(w) + (F.count("v").over(Window.partitionBy("g", "v")) - 1) / 2.0)
    same(average_ranks(rows, "v", ["g"], "r", partitions).select("g", "k", "r"), rows.select("g", "k", rank.alias("r")))
    alone = Window.orderBy(F.col("v").asc_nulls_last())
    rank = F.when(F.col("v").isNotNull(), F.rank().over(alone) + (F.count("v").over(Window.partitionBy("v")) - 1) / 2.0)
    same(average_ranks(rows, "v", [], "r", partitions).select("k", "r"), rows.select("k", rank.alias("r")))


@pytest.mark.parametrize("few", [5, 10_000])
def test_percentiles(rows, few, monkeypatch):
    monkeypatch.setattr(ordered, "BINS", 16)
    finite = rows.withColumn("w", F.when(F.col("v").isNotNull(), 7.0)).withColumn("z", F.pow(F.lit(10.0), F.col("k") / 20) * F.when(F.col("k") % 2 == 0, 1).otherwise(-1))
    p = [0.0, 0.01, 0.5, 0.75, 1.0]
    got = {(r.g, r.value, r.p): r.percentile for r in percentiles(finite, ["v", "w", "z"], p, ["g"], few).collect()}
    want = {}
    for r in finite.groupBy("g").agg(*[F.percentile(c, F.array(*[F.lit(x) for x in p])).alias(c) for c in ("v", "w", "z")]).collect():
        want |= {(r.g, c, x): y for c in ("v", "w", "z") if r[c] for x, y in zip(p, r[c])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert not any(k[:2] == (8, "v") for k in got)
    one = {r.p: r.percentile for r in percentiles(finite, ["v"], [0.5], few=few).collect()}
    assert one[0.5] == finite.agg(F.percentile("v", F.lit(0.5))).first()[0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g int, k long, v double")
    assert placed(none, [F.col("k").asc()], ["g"]).collect() == [] and placed(none, [F.col("k").asc()]).collect() == []
    assert average_ranks(none, "v", ["g"], "r").collect() == [] and percentiles(none, ["v"], [0.5], ["g"]).collect() == []


def test_no_task_gets_all_rows(rows):
    """Every exchange of the rows themselves is by range or hash of many keys; only rows of sizes go to one task."""
    plan = placed(rows, [F.col("v").asc(), F.col("k").asc()])._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("SinglePartition")[1:]:
        assert "Scan parquet" not in part.split("\n")[1]
