"""Mixing sources to target weights by weighted fair queueing.

A document's size is its number of words. Sources are ordered by code point, null last, and
weigh WEIGHTS in turn. Together they get SHARE of all sizes, in proportion to weight; a
source stops at CAP times its own size and what is left goes to the others by weight, until
none is above. The level of this water filling has a closed form over the sources in order of
cap by weight.

Each source is a queue of its documents in hash order, CAP times over, each time in another
order. A document's virtual finish time is the running total of its queue divided by the
queue's target, so all queues are served at rates in proportion to their targets. All items of all queues
are range-sorted by finish time, words are accumulated over the ordered partitions, and the order is cut where
this running total reaches the budget, SHARE of all sizes: totals of partitions tell the one in which it does, and
the items of that one are accumulated. The last item is served in part.

A queue's target is reached at virtual time 1, so the item that a queue serves then is queued as PACKETS packets at most, of a
word each unless it is longer, with finish times of their own. So each source ends within a packet of its
target, and never a whole document away from it.

Running totals of queues need no task that holds a source: rows are dealt to buckets by hash, buckets
are totalled and accumulated by groups of GROUP of them, groups by source, and rows within their bucket alone.

Null text has size 0. Rows that repeat a doc_id are documents of their own. Ties of the
hash order are rows alike in doc_id and text. A source whose sizes are all 0 has target 0. An empty table
gives no rows. Columns other than doc_id, source and text are left out of mix(); mixed_documents()
keeps the columns of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
PACKETS = 1 << 16
#: Rows that a bucket gets, about, and buckets of a group.
BUCKET_ROWS, GROUP = 64, 256
#: A total order of items.
ORDER = ("finish", "doc_id", "turn", "row", "end")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source_key, source_size, target from a row for each source with source_key, source_size. Ordered windows over sources alone."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    known = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (
        known.withColumn("budget", F.sum("source_size").over(whole) * share)
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        # the first source whose cap is above the level that is left is where the water stands
        .withColumn("stands", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source_key", "level"))).over(whole)["level"])
    )
    target = F.least("cap", F.coalesce(F.col("stands") * F.col("weight"), F.col("cap")))
    return level.select("source_key", "source_size", target.alias("target"))


def accumulated(items: DataFrame) -> DataFrame:
    """items with end, the running total of size in their queue: source_key, bucket, then h and row."""
    buckets = items.groupBy("source_key", "bucket").agg(F.sum("size").alias("held")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = buckets.groupBy("source_key", "group").agg(F.sum("held").alias("held"))
    before = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("source_key", "group", before(Window.partitionBy("source_key").orderBy("group")).alias("of_groups"))
    of_buckets = before(Window.partitionBy("source_key", "group").orderBy("bucket"))
    starts = buckets.withColumn("of_buckets", of_buckets).join(groups, ["source_key", "group"]).select("source_key", "bucket", (F.col("of_groups") + F.col("of_buckets")).alias("ahead"))
    within = Window.partitionBy("source_key", "bucket").orderBy("h", "row")
    return items.withColumn("within", F.sum("size").over(within)).join(starts, ["source_key", "bucket"]).withColumn("end", F.col("ahead") + F.col("within"))


def truncated(items: DataFrame, budget: int) -> DataFrame:
    """The items whose running total of words, in order of ORDER, does not pass the budget; the one that crosses it in part."""
    ordered = items.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id())
    ordered = written(ordered, "ordered", even=False)
    ahead, edge = 0, None
    for r in sorted(ordered.groupBy("part").agg(F.sum("words").alias("words")).collect()):  # a row for each partition
        if ahead + r.words > budget:
            edge = r.part
            break
        ahead += r.words
    if edge is None:
        return ordered
    running = F.sum("words").over(Window.partitionBy("part").orderBy(*ORDER))
    room = F.lit(budget - ahead) - (running - F.col("words"))
    last = ordered.where(F.col("part") == edge).withColumn("words", F.least(F.col("words"), room)).where("words > 0")
    return ordered.where(F.col("part") < edge).unionByName(last)


def queues(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The items that are served; the documents' sizes; the sources' targets.

    An item is row, doc_id, turn, end, words (served of it), finish.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        key.alias("source_key"),
        F.md5(text.cast("binary")).alias("text_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    docs = written(docs, "sizes", even=False)
    sources = docs.groupBy("source_key").agg(
        F.sum("size").alias("source_size"), F.first("source").alias("source"), F.ceil(F.count("*") / BUCKET_ROWS).alias("buckets")
    )
    known = written(sources, "sources")
    sources = written(targets(known.drop("buckets"), weights, share, cap), "targets")
    total = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    place = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(2.0**32))
    items = (
        docs.where("size > 0")
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
        .withColumn("h", F.md5(F.concat_ws(":", "doc_id", "turn", "text_hash").cast("binary")))
        .join(known.select("source_key", "buckets"), "source_key")
        .select("row", "doc_id", "turn", "size", "h", "source_key", (F.col("turn") * F.col("buckets") + place).alias("bucket"))
    )
    items = accumulated(items).join(sources.select("source_key", "target"), "source_key")
    in_service = (F.col("end") > F.col("target")) & (F.col("end") - F.col("size") < F.col("target"))
    length = F.when(in_service, F.ceil(F.col("size") / PACKETS)).otherwise(F.col("size"))
    items = items.withColumns({"length": length, "start": F.col("end") - F.col("size"), "last": F.col("end")})
    items = items.withColumn("packet", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("size") / F.col("length")))))
    end = F.least(F.col("start") + F.col("packet") * F.col("length"), F.col("last"))
    words = end - F.col("start") - (F.col("packet") - 1) * F.col("length")
    items = items.select("row", "doc_id", "turn", end.alias("end"), words.alias("words"), (end / F.col("target")).alias("finish"))
    return truncated(items, int(min(share, cap) * total)), docs, sources


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_finish of each document.

    taken counts repeats; first_finish is the finish time of the first item, or packet of one, that is served, null if none is.
    """
    items, docs, sources = queues(documents, weights, share, cap)
    taken = items.groupBy("row").agg(F.sum("words").alias("taken"), F.min("finish").alias("first_finish"))
    return (
        docs.join(taken, "row", "left")
        .join(sources, "source_key")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_finish")
    )


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: a document once for each time it is served, with its own columns.

    One served in part keeps its first words, joined by single spaces, and n_chars, where there, is made to fit.
    Documents without words are never served.
    """
    items, sizes, _ = queues(documents, weights, share, cap)
    # One key for join and window, so that texts are shuffled once.
    key = F.concat_ws(":", "doc_id", "text_hash").alias("key")
    served = items.groupBy("row").agg(F.sum("words").alias("taken")).join(sizes.select("row", key, "size"), "row")
    served = served.groupBy("key", "size").agg(F.sum("taken").alias("taken"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"), F.concat_ws(":", F.col("doc_id").cast("long"), F.md5(text.cast("binary"))).alias("key"))
    # Repeated rows share what they were served: the first of them stands for all.
    place = F.row_number().over(Window.partitionBy("key").orderBy("size"))
    found = docs.join(served, "key").withColumn("place", place).where("place = 1")
    part = F.col("taken") % F.col("size")
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    found = found.select("whole", part.alias("part"), (F.col("taken") / F.col("size")).alias("times"), F.explode(copies).alias("copy"))
    cut = (F.col("part") > 0) & (F.col("copy") > F.col("times"))
    short = F.array_join(F.slice(F.regexp_extract_all(F.col("whole.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    kinds = dict(documents.dtypes)
    columns = {c: F.col("whole").getField(c) for c in documents.columns}
    columns["text"] = F.when(cut, short).otherwise(columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut, F.length(short).cast(kinds["n_chars"])).otherwise(columns["n_chars"])
    return found.select(*[v.alias(c) for c, v in columns.items()])
