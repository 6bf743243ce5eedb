"""JSON blocks as variants: tables of what they hold, with types and nesting kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a value that a table shows.
SHOWN = 200


def _shown(value: Column) -> Column:
    """Text as it is, anything else as JSON."""
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
    return F.substring(text, 1, SHOWN)


def block_table(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, item, key, value, type of JSON texts.

    An object is item 0, an array has an item for each of its objects; values of other arrays have no key. Nested objects and arrays are values,
    as JSON. JSON nulls have a row with a null value. Texts that are no JSON, empty ones and scalars give no row.
    """
    opened = df.select(*keys, F.try_parse_json(F.col(column)).alias("_v")).where(F.col("_v").isNotNull())
    rows = opened.withColumn("_array", F.schema_of_variant("_v").startswith("ARRAY"))
    spark = df.sparkSession
    first = rows.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_key", "_value"))
    objects = first.where(~F.col("_array")).select(*keys, F.lit(0).alias("item"), F.col("_key").alias("key"), "_value")
    elements = first.where("_array").select(*keys, F.col("_pos").alias("item"), "_value")
    element = F.schema_of_variant("_value").startswith("OBJECT")
    plain = elements.where(~element).select(*keys, "item", F.lit(None).cast("string").alias("key"), "_value")
    named = elements.where(element).withColumnRenamed("_value", "_v").lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_key", "_value"))
    cells = objects.unionByName(plain).unionByName(named.select(*keys, "item", F.col("_key").alias("key"), "_value"))
    null = F.is_variant_null("_value")
    return cells.select(*keys, "item", "key", F.when(~null, _shown(F.col("_value"))).alias("value"), F.when(~null, F.schema_of_variant("_value")).alias("type"))
