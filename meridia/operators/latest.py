"""Latest row by key, and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str], rest: list[str] | None = None) -> DataFrame:
    """The row of each key with the greatest order columns: a plain maximum of structs, combined before the shuffle.

    Rows whose first order column is null are left out.
    """
    rest = [c for c in (rest or df.columns) if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.where(F.col(order[0]).isNotNull()).groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [*order, *rest]])


def _fill(probes: DataFrame, data: DataFrame, by: list[str], probe_time: str, data_time: str, values: list[str], exact: bool) -> DataFrame:
    side = 1 if exact else -1
    left = probes.withColumns({"_t": F.col(probe_time), "_side": F.lit(side)})
    right = data.select(*by, F.col(data_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(data_time).alias("_at"), *values).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where(F.col("_side") != 0).drop("_t", "_side", "_v")


def as_of_join(
    probes: DataFrame,
    data: DataFrame,
    by: list[str],
    probe_time: str,
    data_time: str,
    values: dict[str, str],
    at: str | None = None,
    exact: bool = True,
    period: Column | None = None,
) -> DataFrame:
    """Each probe with the values (output name -> column of data) of the latest row of its key at or before probe_time.

    exact=False takes rows strictly before. at names an output column for the time found. Probes without such a row get nulls.
    One union, one shuffle on the key and one sorted pass; no range join. With period, an expression over a column
    _time that coarsens it, a key's history is dealt out by period: rows look inside their own period first, then take
    the last row of the nearest earlier period, so that one long history does not make one long task.
    """
    data = data.where(F.col(data_time).isNotNull()).select(*by, F.col(data_time).alias("_time"), *[F.col(c).alias(f"_v_{o}") for o, c in values.items()])
    columns = [f"_v_{o}" for o in values]
    if period is None:
        found = _fill(probes, data, by, probe_time, "_time", columns, exact)
    else:
        coarse = data.withColumn("_period", period)
        asked = probes.withColumn("_time", F.col(probe_time)).withColumn("_period", period).drop("_time")
        inside = _fill(asked, coarse, [*by, "_period"], probe_time, "_time", columns, exact).withColumnRenamed("_found", "_inside")
        ends = latest_by(coarse, [*by, "_period"], ["_time"], columns)
        periods = inside.select(*by, "_period").distinct()
        before = _fill(periods, ends.withColumnRenamed("_period", "_p"), by, "_period", "_p", ["_time", *columns], exact=False)
        before = before.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_period").alias("_k_period"), F.col("_found").alias("_before"))
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col("_period").eqNullSafe(F.col("_k_period"))]
        joined = inside.join(before, same, "left")
        pick = lambda c: F.when(F.col("_inside._at").isNotNull(), F.col(f"_inside.{'_at' if c == '_time' else c}")).otherwise(F.col(f"_before.{c}"))
        found = joined.withColumn("_found", F.struct(pick("_time").alias("_at"), *[pick(c).alias(c) for c in columns]))
    out = [*probes.columns, *[F.col(f"_found._v_{o}").alias(o) for o in values]]
    return found.select(*out, *([F.col("_found._at").alias(at)] if at else []))
