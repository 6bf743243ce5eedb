"""Row frames over long histories in blocks of rows, and the k-th latest rows of several sources as of a time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_blocks(df: DataFrame, by: list[str], order: str, frames: dict, back: int, ahead: int = 0, block: int = 65_536, period: Column | None = None) -> DataFrame:
    """df with columns from frames over rows of at most `back` before and `ahead` after, exact, without a task for a whole history.

    frames gives each new column as a function of a window by group in order; it may use lag, lead and rows between within the stated
    bounds. A group's rows get their numbers from the counts of its periods (period coarsens order: a month, say; the year
    if it is a date), are dealt out in blocks of `block` rows, and each block gets copies of the `back` rows before and the `ahead` rows after it,
    however many periods these are from. Order is unique within a group.
    """
    if block < max(back, ahead, 1):
        raise ValueError(f"a block of {block} rows cannot give frames of {back} before and {ahead} after")
    period = F.year(order) if period is None else period
    rows = df.withColumn("_period", period)
    sizes = rows.groupBy(*by, "_period").agg(F.count("*").alias("_size"))
    # a row for each period
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy(F.col("_period").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in [*by, "_period"]], F.coalesce(before, F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "_period"]])
    within = F.row_number().over(Window.partitionBy(*by, "_period").orderBy(F.col(order).asc_nulls_first()))
    at = F.col("_before") + F.col("_within") - 1
    numbered = rows.withColumn("_within", within).join(offsets, same).withColumn("_at", at).select(*df.columns, "_at")
    home, place = F.floor(F.col("_at") / block), F.col("_at") % block
    copies = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("shift"), F.lit(True).alias("own")),
            F.when(place >= block - back, F.struct(F.lit(1).alias("shift"), F.lit(False).alias("own"))),
            F.when(F.lit(ahead > 0) & (place < ahead) & (home > 0), F.struct(F.lit(-1).alias("shift"), F.lit(False).alias("own"))),
        )
    )
    dealt = numbered.withColumn("_copy", F.explode(copies)).withColumn("_block", home + F.col("_copy.shift"))
    w = Window.partitionBy(*by, "_block").orderBy("_at")
    return dealt.withColumns({name: f(w) for name, f in frames.items()}).where("_copy.own").select(*df.columns, *frames)


@dataclass(frozen=True)
class Source:
    """Rows that are known from `known` on, the later ones those of a greater `order`; values are the columns wanted of them."""

    rows: DataFrame
    known: str | Column
    order: str
    values: list[str]


def latest_as_of(probes: DataFrame, sources: dict[str, Source], by: list[str], at: str, k: int = 1) -> DataFrame:
    """probes with a column a source: an array of structs (order, values), of its k latest rows among those known at the probe's time, latest first.

    All sources and the probes are one union, shuffled once by key and passed once in order of time. Each pass carries a running maximum a place: what
    loses to the first place, as it stands or arrives, runs for the second, and so on; so rows that become known late, or out of
    order, count as soon as they are known and no later. Rows whose `known` or order is null are never known. Of rows with equal order the
    greatest stand first. No pairs of probes and rows are made.
    """
    parts = [probes.withColumns({"_at": F.col(at), "_side": F.lit(1)})]
    for name, s in sources.items():
        known = F.col(s.known) if isinstance(s.known, str) else s.known
        row = F.struct(F.col(s.order), *[F.col(v) for v in s.values])
        known_rows = s.rows.where(F.col(s.order).isNotNull()).select(*by, known.alias("_at"), F.lit(0).alias("_side"), row.alias(f"_in_{name}_0"))
        parts.append(known_rows.where(F.col("_at").isNotNull()))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    w = Window.partitionBy(*by).orderBy("_at", "_side", *[f"_in_{name}_0" for name in sources])
    so_far, earlier = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    for place in range(k):
        step: dict[str, Column] = {}
        for name in sources:
            runs = F.col(f"_in_{name}_{place}")
            best = F.max(runs).over(earlier)
            step[f"_top_{name}_{place}"] = F.max(runs).over(so_far)
            # least() skips nulls: a row that meets no other loses to none
            step[f"_in_{name}_{place + 1}"] = F.when(runs.isNotNull() & best.isNotNull(), F.least(runs, best))
        both = both.withColumns(step)
    tops = [F.array_compact(F.array(*[F.col(f"_top_{name}_{p}") for p in range(k)])).alias(name) for name in sources]
    return both.where("_side = 1").select(*probes.columns, *tops)
