"""Writes that a transactional table would do in place, as transformations of the old and the new rows.

Each is one grouped pass over both sides, keyed by the primary key; within a side keys are unique, or
the row with the greatest values stands. Columns are those of the old side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.sources.workspace import discard, written


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("_new", F.lit(False)).unionByName(new.select(*[c for c in old.columns if c in new.columns]).withColumn("_new", F.lit(True)), allowMissingColumns=True)


def _side(c: str, new: bool) -> Column:
    return F.max(F.when(F.col("_new") == new, F.col(c)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key whole."""
    rest = [c for c in old.columns if c not in keys]
    whole = F.max(F.struct("_new", *rest)).alias("_row")
    return _both(old, new).groupBy(*keys).agg(whole).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*old.columns)


def upsert_partial(old: DataFrame, new: DataFrame, keys: list[str], refreshed: list[str]) -> DataFrame:
    """On conflict only the refreshed columns change; the others keep their first value."""
    pick = lambda c: F.coalesce(_side(c, True), _side(c, False)) if c in refreshed else F.when(F.max(~F.col("_new")), _side(c, False)).otherwise(_side(c, True))
    return _both(old, new).groupBy(*keys).agg(*[pick(c).alias(c) for c in old.columns if c not in keys]).select(*old.columns)


def coalescing_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A new value replaces an old one unless it is null."""
    return _both(old, new).groupBy(*keys).agg(*[F.coalesce(_side(c, True), _side(c, False)).alias(c) for c in old.columns if c not in keys]).select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows come in only where their key is not there yet; of several the greatest."""
    rest = [c for c in old.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]) if rest else new.select(*keys).distinct()
    return old.unionByName(one.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def enrich(old: DataFrame, new: DataFrame, keys: list[str], fill: list[str], zero: list[str] | None = None) -> DataFrame:
    """Old rows matched null-safely take the new values of `fill` where their own is null, or 0 in the columns `zero` (all, if not given).

    None is added.
    """
    zero = fill if zero is None else zero
    given = new.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*[F.max(c).alias(f"_n_{c}") for c in fill])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    mine = lambda c: F.when(F.col(c) != 0, F.col(c)) if c in zero else F.col(c)
    own = lambda c: F.coalesce(mine(c), F.col(f"_n_{c}"), F.col(c)).alias(c)
    return old.join(given, same, "left").select(*[own(c) if c in fill else F.col(c) for c in old.columns])


def update_from_entries(old: DataFrame, blocks: DataFrame, keys: list[str], block: str, section: str, fields: dict[str, str], keyed: dict[str, str]) -> DataFrame:
    """Old rows whose first filled column is null take values from JSON blocks; none is added.

    A block is text {section: {any: entry}}, beside the key columns that it has itself. keyed gives the entry's field for each other key, fields
    that for each column to fill, the deciding one first; entries without one of these keys or the deciding field do not count.
    """
    entries = F.from_json(F.get_json_object(block, f"$.{section}"), "map<string,map<string,string>>")
    given = blocks.select(*[k for k in keys if k not in keyed], F.explode(entries).alias("_", "_e"))
    kinds = dict(old.dtypes)
    read = lambda names: [F.col("_e")[f].try_cast(kinds[c]).alias(c) for c, f in names.items()]
    given = given.select(*[k for k in keys if k not in keyed], *read(keyed), *read(fields))
    decides = next(iter(fields))
    for c in (*keyed, decides):
        given = given.where(F.col(c).isNotNull())
    one = given.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("_given"))
    take = lambda c: F.when(F.col(decides).isNull() & F.col("_given").isNotNull(), F.col(f"_given.{c}")).otherwise(F.col(c))
    return old.join(one, keys, "left").select(*[take(c).alias(c) if c in fields else F.col(c) for c in old.columns])


def _digest(df: DataFrame) -> tuple:
    columns = sorted(df.columns)
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())


def replace_slice(df: DataFrame, path: str, by: str) -> int:
    """Writes df over the partitions of `by` that it holds, leaves the others, and reads its rows back.

    df is evaluated once, to a folder of its own that is removed at the end, so a plan with ties or times in it is compared with
    itself. Gives the number of rows; raises if they are not the rows that were to be written.
    """
    spark, df = df.sparkSession, written(df, "staged")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    kinds = dict(df.dtypes)
    back = spark.read.parquet(path).withColumn(by, F.col(by).cast(kinds[by])).join(df.select(by).distinct(), by, "left_semi")
    wanted, found = _digest(df), _digest(back)
    discard(df)
    if wanted != found:
        raise ValueError(f"{path}: {found[0]} rows read back do not equal the {wanted[0]} that were written")
    return found[0]
