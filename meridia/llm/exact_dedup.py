"""Exact duplicates: a Golomb-coded fingerprint exchange, then byte verification of suspects.

1. Each partition of fingerprints (the sender) sends every owner of a range of the hash space its
   distinct fingerprints of that range, sorted and Golomb-Rice coded.
   A sender knows at most FAN ranges. Where there are more owners, what several senders sent to one range is merged,
   about OWNED fingerprints at a time, and these merged senders divide the range further. So the messages of a
   partition, or of OWNED fingerprints, are at most FAN, and all messages grow with the table and not with its square.
2. An owner answers each sender with a bitmap: which of these some other sender has too.
3. The fingerprints marked so, and those a sender has twice itself, are suspects. Up to MOST_SUSPECTS of them make
   a Bloom filter of 16 to 32 bits each, which is broadcast; more are joined with the rows by fingerprint.
4. Only suspects' rows and texts are shuffled: Spark groups texts by their bytes, after partial
   aggregation, so a large group of copies sends one row a task. All other rows stay where they are read.

Texts are compared after each run of ASCII white space is replaced by one space; null counts as
empty. The row with the smallest doc_id of a group stays; null doc_ids come last. Of rows that
repeat that doc_id too, exactly one stays. An empty table gives no rows. Columns other
than doc_id and text are left out of groups(); first_copies() keeps the columns of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, fan_out, written

#: Fingerprints that an owner has to hold, about.
OWNED = 1_000_000
#: Ranges that a sender divides its fingerprints among, at most.
FAN = 256
#: Suspects that a Bloom filter is made of, at most; it has 16 MB then.
MOST_SUSPECTS = 1 << 22
BLOOM_HASHES = 4
#: Runs of white space other than one space, so that most texts are only looked through.
_ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _ODD_SPACE, " ")


def golomb_encode(sorted_values: np.ndarray) -> bytes:
    """Rice code of the gaps of ascending unsigned 64-bit values: a header, all quotients in unary, all remainders."""
    n = len(sorted_values)
    if not n:
        return b""
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(gaps.astype(np.float64).mean()) * 0.69))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    head = np.array([n, k, len(unary)], "<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    if not code:
        return np.zeros(0, np.uint64)
    n, k, length = (int(x) for x in np.frombuffer(code[:12], "<u4"))
    at = 12 + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(code[12:at], np.uint8), count=length)
    quotient = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    gaps = quotient.astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(code[at:], np.uint8), count=n * k).reshape(n, k)
        gaps += (bits.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


_MESSAGES = "owner int, sender int, message binary, twice binary"


def _messages(values: np.ndarray, twice: np.ndarray, owners: int, sender: int) -> pa.RecordBatch:
    """A row for each owner of some of the ascending values, of all owners of the hash space."""
    owner = ((values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
    known, starts = np.unique(owner, return_index=True)
    ends = [*starts[1:].tolist(), len(values)]
    return pa.RecordBatch.from_pylist(
        [
            {"owner": k, "sender": sender, "message": golomb_encode(values[a:b]), "twice": np.packbits(twice[a:b]).tobytes()}
            for k, a, b in zip(known.tolist(), starts.tolist(), ends)
        ],
        pa.schema([("owner", pa.int32()), ("sender", pa.int32()), ("message", pa.binary()), ("twice", pa.binary())]),
    )


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b.column("fp").to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if got:
            values, counts = np.unique(np.concatenate(got).view(np.uint64), return_counts=True)
            yield _messages(values, counts > 1, owners, TaskContext.get().partitionId())

    return run


def _merged(owners: int):
    """What the senders of one lane sent to one range, as the messages of one sender to the owners in it."""

    def run(rows: pa.Table) -> pa.Table:
        lists = [golomb_decode(m) for m in rows.column("message").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)) for m, x in zip(rows.column("twice").to_pylist(), lists)]
        values, at = np.unique(np.concatenate(lists), return_inverse=True)
        times = np.bincount(at, 1.0 + np.concatenate(twice), len(values))
        return pa.Table.from_batches([_messages(values, times > 1, owners, rows.column("lane")[0].as_py())])

    return run


def _answer(messages: pa.Table) -> pa.Table:
    lists = [golomb_decode(m) for m in messages.column("message").to_pylist()]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    bitmaps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
    return pa.table([messages.column("owner"), messages.column("sender"), pa.array(bitmaps, pa.binary())], ["owner", "sender", "bitmap"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for message, *maps in zip(*(batch.column(c).to_pylist() for c in ("message", "twice", "bitmap"))):
            values = golomb_decode(message)
            twice, shared = (np.unpackbits(np.frombuffer(m, np.uint8), count=len(values)) for m in maps)
            yield pa.record_batch([pa.array(values[(twice | shared) > 0].view(np.int64))], ["fp"])


def suspect_fingerprints(fingerprints: DataFrame, n: int) -> DataFrame:
    """fp of which the column fp has more than one. n: its number of rows, about."""
    least = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners, hops = fan_out(max(1, least, n // OWNED), FAN)
    ranges = owners ** (1 / hops)
    sent = fingerprints.mapInArrow(_send(round(ranges)), _MESSAGES)
    for hop in range(1, hops):
        lane = F.pmod("sender", F.lit(max(1, round(n / OWNED / ranges**hop)))).cast("int")
        sent = sent.withColumn("lane", lane).groupBy("owner", "lane").applyInArrow(_merged(round(ranges ** (hop + 1))), _MESSAGES)
    sent = written(sent, "fingerprints")
    bitmaps = sent.select("owner", "sender", "message").groupBy("owner").applyInArrow(_answer, "owner int, sender int, bitmap binary")
    return written(sent.join(bitmaps, ["owner", "sender"]).mapInArrow(_marked, "fp long"), "suspects")


def in_bloom(table: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether each fingerprint may be in a filter."""
    x = fp.view(np.uint64)
    low, high, found = x & np.uint64(2**32 - 1), x >> np.uint64(32), np.ones(len(x), bool)
    for i in range(BLOOM_HASHES):
        bit = (low + np.uint64(i) * high) & np.uint64(len(table) * 64 - 1)
        found &= (table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)) > 0
    return found


def bloom_table(suspects: DataFrame):
    """The broadcast bits of a filter over the column fp of suspects."""
    bits = 1 << max(10, (16 * suspects.count()).bit_length())
    at = F.expr(f"transform(sequence(0, {BLOOM_HASHES - 1}), i -> ((fp & 4294967295) + i * shiftrightunsigned(fp, 32)) & {bits - 1})")
    words = (
        suspects.select(F.explode(at).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
        .toArrow()
    )
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return suspects.sparkSession.sparkContext.broadcast(table)


def bloom_filter(shared):
    """A Column -> Column that is true for each fp of a broadcast filter, and seldom for others."""

    @F.pandas_udf("boolean")
    def maybe(fp: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(shared.value, fp.to_numpy(np.int64)))

    return maybe


class Suspects:
    """Tells rows whose fingerprints are in the column fp of a table from others. May take some others for suspects.

    bits is the broadcast filter, for tasks that run Python anyway; None if there are too many suspects for one.
    """

    def __init__(self, fingerprints: DataFrame):
        self.fingerprints = fingerprints
        self.bits = bloom_table(fingerprints) if fingerprints.count() <= MOST_SUSPECTS else None
        self.maybe = bloom_filter(self.bits) if self.bits else None

    def among(self, df: DataFrame, fp: Column) -> tuple[DataFrame, DataFrame]:
        """The suspects of df, and the others."""
        if self.maybe:
            return df.where(self.maybe(fp)), df.where(~self.maybe(fp))
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), fp.alias("fp"))
        known = self.fingerprints.select("fp").distinct()
        suspects, others = (rows.join(known, "fp", how).select("whole.*") for how in ("left_semi", "left_anti"))
        return suspects, others


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each document."""
    docs = documents_of(documents).select("doc_id", normal_text(F.col("text")).alias("normal"))
    sha = F.unhex(F.sha2(F.col("normal").cast("binary"), 256)).alias("sha")
    each = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("normal").alias("fp"), sha)
    each = written(each, "fingerprinted", even=False)
    suspects = Suspects(suspect_fingerprints(each.select("fp"), each.count()))
    texts, _ = suspects.among(docs.select("normal"), F.xxhash64("normal"))
    verified = texts.groupBy("normal").agg(F.count("*").alias("group_size")).where("group_size > 1").select(sha, "group_size")
    asked, others = suspects.among(each, F.col("fp"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = asked.groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = verified.join(first, "sha").select("sha", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    found = written(found, "groups")  # so that the next join's hot keys can be split
    single = F.col("group_size").isNull()
    text_sha256 = F.lower(F.hex("sha")).alias("text_sha256")
    told = asked.join(found, "sha", "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        text_sha256,
    )
    return told.unionByName(others.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), text_sha256))


def first_copies(documents: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    fp = F.xxhash64(normal_text(F.col("text")))
    each = written(documents.select(fp.alias("fp")), "fingerprinted", even=False)  # read by few tasks, so there are few senders
    asked, others = Suspects(suspect_fingerprints(each, each.count())).among(documents, fp)
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    asked = asked.select(normal_text(F.col("text")).alias("normal"), whole.alias("whole"), order.alias("order"))
    stay = asked.groupBy("normal").agg(F.min_by("whole", "order").alias("whole")).select("whole.*")
    return others.unionByName(stay)
