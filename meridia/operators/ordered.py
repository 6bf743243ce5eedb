"""Places, ranks, tiles, bins and exact percentiles of groups that may be the whole table, without a task that sees a group whole.

Rows are range-partitioned by group and order, so a group lies in as many tasks as it needs. The row's number in its task comes with the
sorted pass; the sizes of the tasks, one row each, give the offsets; first places of groups and of ties are aggregates. The
sorted rows are written once to the shared folder, so that offsets and rows are of one and the same partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.sources.workspace import discard, written

#: A row's number in its task is the lower part of monotonically_increasing_id.
_TASK_BITS = 33


def same_of(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """A null-safe join of the right side's columns that are not in by."""
    right = right.withColumnsRenamed({c: f"_of_{c}" for c in by})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], F.lit(True))
    return left.join(right, on, how).drop(*[f"_of_{c}" for c in by])


def placed(df: DataFrame, order: list[Column], by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """df with _place, from 1 in the order within each group of by, and _n, the rows of the group. Nulls in by are a group.

    Rows that are equal in by and order get places in any order, so an order that should be total ends in a key.
    """
    by = by or []
    keys = [F.col(c).asc_nulls_first() for c in by] + order
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    rows = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged", even=False)
    task = F.shiftrightunsigned("_id", _TASK_BITS)
    sizes = rows.groupBy(task.alias("_task")).agg(F.count("*").alias("_size"))
    # a row for each task
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_task", before.alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_n"))
    numbered = rows.withColumn("_task", task).join(F.broadcast(offsets), "_task")
    numbered = numbered.withColumn("_place", F.col("_before") + F.col("_id").bitwiseAND((1 << _TASK_BITS) - 1) + 1).drop("_task", "_before", "_id")
    if not by:
        return numbered
    numbered = numbered.drop("_n")
    groups = numbered.groupBy(*by).agg((F.min("_place") - 1).alias("_first"), F.count("*").alias("_n"))
    return same_of(numbered, groups, by, "inner").withColumn("_place", F.col("_place") - F.col("_first")).drop("_first")


def tile(n: int) -> Column:
    """NTILE from _place and _n: the first tiles take one row more where n does not divide."""
    small, larger, place = F.floor(F.col("_n") / n), F.col("_n") % n, F.col("_place")
    within = larger * (small + 1)
    return F.when(place <= within, F.floor((place - 1) / (small + 1)) + 1).otherwise(larger + F.floor((place - within - 1) / small) + 1).cast("int")


def bin_of(bins: int) -> Column:
    """Bins from 0: the place scaled to the whole range, in whole numbers."""
    place, n = F.col("_place"), F.col("_n")
    return F.greatest(F.lit(0), F.floor(((place - 1) * bins + n - 2) / F.greatest(n - 1, F.lit(1))) - 1).cast("int")


def average_ranks(df: DataFrame, value: str, by: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """df with the rank of value in its group, ties at their mean; nulls get none.

    Only distinct values with their counts are put in order; counts combine before the shuffle. df is evaluated for the ranks and again for
    the join by value, so a value that can come out otherwise the second time (a mean of doubles, summed in the order in which blocks arrive) is written first.
    """
    return same_of(df, ranks_of(df, value, by, name, partitions), [*by, value], "left")


def ranks_of(df: DataFrame, value: str, by: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """by, value and its rank: a row for each distinct value of each group that is not null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_count"))
    keys = [F.col(c).asc_nulls_first() for c in [*by, value]]
    ranged = counts.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    rows = written(ranged.withColumn("_task", F.spark_partition_id()), "counted", even=False)
    sizes = rows.groupBy(*by, "_task").agg(F.sum("_count").alias("_size"))
    # a row for each group and task that it lies in
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*by, "_task", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_count").over(Window.partitionBy(*by, "_task").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.col("_before") + F.col("_up_to") - (F.col("_count") - 1) / 2.0
    return same_of(rows.withColumn("_up_to", within), offsets, [*by, "_task"], "inner").select(*by, value, rank.alias(name))


#: Bins of a refinement, and values at which a bin is small enough to be sorted.
BINS, FEW = 512, 4096


def percentiles(df: DataFrame, values: list[str], probabilities: list[float], by: list[str] | None = None, few: int = FEW) -> DataFrame:
    """by, value (its name), p, percentile: interpolated as percentile() does, exact, nulls and not-a-numbers left out.

    Each wanted rank starts with the range of its group. A round counts the group's rows in equal bins of the range and goes on with the bin that
    holds the rank, narrowed to the least and the greatest value in it, until that is one value or holds few. Rounds pass over
    the rows with counts only, which combine before the shuffle; no task gets a group's values. Groups without values give no row.
    """
    by = by or []
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("x")) for v in values])).alias("_pair")
    rows = df.select(*by, pairs).select(*by, "_pair.*").where(F.col("x").isNotNull() & ~F.isnan("x"))
    group = [*by, "value"]
    rows = written(rows, "measured", even=False)
    whole = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    h = (F.col("n") - 1) * F.col("p")
    asked = whole.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(h).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(h).alias("rank")))).alias("_r")
    open_ = written(asked.select(*group, "p", "low", "high", "n", both).select(*group, "p", "_r.*", "low", "high", F.col("n").alias("inside")), "ranks")
    found: list[DataFrame] = []
    target = [*group, "p", "side"]
    while True:
        done = F.col("low") == F.col("high")
        found.append(open_.where(done).select(*target, F.col("low").alias("x")))
        small = open_.where(~done & (F.col("inside") <= few))
        inside = _within(rows, small, group)
        nth = F.element_at(F.sort_array(F.collect_list("x")), (F.first("rank") + 1).cast("int"))
        found.append(inside.groupBy(*target).agg(nth.alias("x")))
        left = open_.where(~done & (F.col("inside") > few))
        if left.isEmpty():
            break
        open_ = written(_refined(_within(rows, left, group), target), "ranks")
    sides = reduce(DataFrame.unionByName, found).groupBy(*group, "p").agg(*[F.max(F.when(F.col("side") == s, F.col("x"))).alias(f"_{s}") for s in (0, 1)])
    counts = whole.select(*group, "n")
    joined = same_of(sides, counts, group, "inner").withColumn("_part", h - F.floor(h))
    answer = F.when(F.col("_0") == F.col("_1"), F.col("_0")).otherwise((1 - F.col("_part")) * F.col("_0") + F.col("_part") * F.col("_1"))
    made = written(joined.select(*group, "p", answer.alias("percentile")), "percentiles")
    discard(rows)
    return made


def _within(rows: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """The rows in the range of each target of their group; there are a few targets a group."""
    found = same_of(rows, targets.select(*group, F.struct(*[c for c in targets.columns if c not in group]).alias("_t")), group, "inner")
    return found.where((F.col("x") >= F.col("_t.low")) & (F.col("x") <= F.col("_t.high"))).select(*group, "x", "_t.*")


def _refined(inside: DataFrame, target: list[str]) -> DataFrame:
    half = lambda c: F.least(F.greatest(F.col(c), F.lit(-1.7e308)), F.lit(1.7e308)) / 2  # noqa: E731  infinities too
    share = (half("x") - half("low")) / F.greatest(half("high") - half("low"), F.lit(5e-324))
    number = F.when(F.col("x") == F.col("high"), BINS).when(F.col("x") == F.col("low"), -1).otherwise(F.floor(share * BINS)).cast("int")
    binned = inside.withColumn("bin", F.least(F.greatest(number, F.lit(-1)), F.lit(BINS)))
    bins = binned.groupBy(*target, "rank", "bin").agg(F.count("*").alias("inside"), F.min("x").alias("low"), F.max("x").alias("high"))
    # at most BINS + 2 rows a target
    up_to = F.sum("inside").over(Window.partitionBy(*target).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    here = bins.withColumn("_up_to", up_to).where((F.col("_up_to") > F.col("rank")) & (F.col("_up_to") - F.col("inside") <= F.col("rank")))
    return here.withColumn("rank", F.col("rank") - (F.col("_up_to") - F.col("inside"))).select(*target, "rank", "low", "high", "inside")
