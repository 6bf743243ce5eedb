"""Cross-sectional statistics by group: average ranks, z-scores, winsorising, bins, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.sources.workspace import discard, written

from .ordered import bin_of, percentiles, placed, ranks_of, same_of


def z_scores(df: DataFrame, values: dict[str, Column], by: list[str]) -> DataFrame:
    """df with a z-score for each of values, against the population deviation; null where that is 0. Infinities count as missing.

    Means and deviations are aggregated, which combines before the shuffle, and joined back: the cross-section itself stays where it is.
    """
    df = df.withColumns({f"_z_{n}": finite(v) for n, v in values.items()})
    moments = [f(f"_z_{n}").alias(f"_{k}_{n}") for n in values for k, f in (("mean", F.avg), ("spread", F.stddev_pop))]
    z = {n: F.when(F.col(f"_spread_{n}") > 0, (F.col(f"_z_{n}") - F.col(f"_mean_{n}")) / F.col(f"_spread_{n}")) for n in values}
    scratch = [f"_{k}_{n}" for n in values for k in ("z", "mean", "spread")]
    return df.join(df.groupBy(*by).agg(*moments), by).withColumns(z).drop(*scratch)


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def winsorise(df: DataFrame, value: str, by: list[str], tails: float = 0.01) -> DataFrame:
    """value held between its interpolated quantiles of each group."""
    found = percentiles(df, [value], [tails, 1 - tails], by)
    of = lambda p: F.max(F.when(F.col("p") == p, F.col("percentile")))
    edges = found.groupBy(*by).agg(of(tails).alias("_low"), of(1 - tails).alias("_high"))
    return df.join(edges, by).withColumn(value, F.greatest(F.col("_low"), F.least(F.col("_high"), F.col(value)))).drop("_low", "_high")


def equal_bins(df: DataFrame, value: str, key: str, by: list[str], bins: int = 10) -> DataFrame:
    """df with bin, from 0, by place in order of value then key."""
    return placed(df, [F.col(value).asc(), F.col(key).asc()], by).withColumn("bin", bin_of(bins)).drop("_place", "_n")


def rank_correlation(df: DataFrame, a: str, b: str, by: list[str], least: int = 30) -> DataFrame:
    """by, n, ic: Spearman's correlation of each group of at least `least` rows where both are known.

    df is evaluated once: ranks are joined back by value, and a mean of doubles that is summed again, in another order, need not be equal to itself.
    """
    both = written(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("_x"), F.col(b).alias("_y")), "pairs", even=False)
    ranked = both
    for value, name in (("_x", "_a"), ("_y", "_b")):
        ranked = same_of(ranked, ranks_of(both, value, by, name), [*by, value], "left")
    made = written(ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("ic")).where(F.col("n") >= least), "correlations")
    discard(both)
    return made
