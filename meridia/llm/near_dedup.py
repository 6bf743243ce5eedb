"""Near duplicates: MinHash bands for candidates, odd sketches to pick them, full sets to confirm them.

A document's set is its distinct shingles of `width` words (ASCII capitals folded); with fewer
words the whole sequence is its one shingle; without words it is empty and linked with nothing.

1. Each document gives BANDS * ROWS MinHash samples of its set. Each band of ROWS samples is a
   bucket key. All samples are folded into an odd sketch, a bitmap of SKETCH_BITS parities, so the
   bits in which two sketches differ estimate the samples in which the documents differ.
   At a similarity of 0.8 a pair shares no band with a probability of 3e-6.
2. Documents with equal sets are one class; one of them stands for it from here on.
3. In each bucket all members are paired with one pivot, which differs from band to band. Pairs
   whose sketches differ by no more than `reach` bits, five standard deviations above the mean
   at the threshold, are confirmed on their full sets, and links give components.
4. What a star can miss: in buckets whose members lie in more than one component, members outside
   the largest are compared with all others in cells of about CHUNK by CHUNK, first by sketch; members that have
   a near one in another component come again with their full sets, and a cell emits the links that join components.
5. Where more than CHUNK members lie outside, a template far from the threshold has filled the bucket. The members of all such
   buckets are dealt anew, by single shingles: ordered from rare to common, two sets at the threshold share one of the
   first ninth of the smaller and the first fifth of the larger (at 0.8), so each member goes to the buckets of its first
   shingles and those it owns alone or shares with its template are left behind. This loses no pair. The new buckets
   are compared in cells as above.
6. Components of all links.

So pairs within a group are never all emitted, and no link between different sets is lost but by the chances above.
Full sets are made again only for documents in pairs that passed the sketches.

Null text is empty text. Repeated rows and equal or null doc_ids are documents of their own;
component_id is the smallest doc_id that is not null, null if there is none. An empty table gives
no rows. Columns other than doc_id and text are left out of near_duplicates(); one_of_each() keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents_of, mixed, written
from .components import components
from .exact_dedup import Suspects, in_bloom

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
CHUNK = 1024
#: Places in which the shingles of crowded buckets are counted, to tell rare from common; the order need not be exact.
TALLY = 1 << 20
#: Rows of a group in which chunks of buckets are compared, about.
GROUP_ROWS = 4096

_P = np.uint64(0x9E3779B97F4A7C15)
_COUNT = np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64)
_A = (mixed(_COUNT[:SAMPLES] * _P) | np.uint64(1))[:, None]
_B = mixed(_COUNT[SAMPLES:] * _P)[:, None]


class _Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(_words().__getitem__, words)), np.uint64)
    span = min(width, len(h))
    n = len(h) - span + 1
    x = np.full(n, span, np.uint64)
    for k in range(span):
        x = mixed(x * _P + h[k : k + n])
    return np.unique(x)


def minhash(x: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 512):
        np.minimum(low, (_A * x[k : k + 512] + _B).min(axis=1), out=low)
    return low


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """The parities of the samples that fall on each bit."""
    bit = mixed(low + _COUNT[:SAMPLES] * _P) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    bands = low.reshape(BANDS, ROWS)
    key = _COUNT[:BANDS]
    for k in range(ROWS):
        key = mixed(key * _P + bands[:, k])
    return key.view(np.int64)


def reach(similarity: float) -> int:
    """Bits in which the sketches of two documents at this similarity may differ: the mean and five standard deviations."""
    differ = SAMPLES * (1 - similarity)
    mean = SKETCH_BITS / 2 * (1 - math.exp(-4 * differ / SKETCH_BITS))
    slope = 2 * math.exp(-4 * differ / SKETCH_BITS)
    return math.ceil(mean + 5 * math.sqrt(slope**2 * SAMPLES * similarity * (1 - similarity) + mean * (1 - mean / SKETCH_BITS)))


def set_key(x: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(x.tobytes())


_SIGNATURE = "row long, doc_id long, fp long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


def _signatures(width: int):
    def lists(rows: list[np.ndarray | None], wide: int) -> pa.Array:
        ends = np.cumsum([0] + [wide if r is not None else 0 for r in rows]).astype(np.int32)
        flat = [r for r in rows if r is not None]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                n, keys, bands, sketches = [], [], [], []
                for text in batch.column("text").to_pylist():
                    x = shingles(text, width)
                    low = minhash(x) if len(x) else None
                    n.append(len(x))
                    keys.append(set_key(x) if len(x) else None)
                    bands.append(band_keys(low) if len(x) else None)
                    sketches.append(odd_sketch(low) if len(x) else None)
                yield pa.record_batch(
                    [
                        pa.array(np.arange(row, row + batch.num_rows)),
                        batch.column("doc_id"),
                        batch.column("fp"),
                        pa.array(n, pa.int64()),
                        pa.array(keys, pa.binary()),
                        lists(bands, BANDS),
                        lists(sketches, SKETCH_BITS // 64),
                    ],
                    ["row", "doc_id", "fp", "n_shingles", "set_key", "bands", "sketch"],
                )
                row += batch.num_rows
        pa.default_memory_pool().release_unused()  # the worker stays for other stages

    return run


def _sets(width: int, wanted):
    """set_key and members of the texts whose fingerprints are in the filter, of all without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, keys, sets = set(), [], []
            texts = batch.column("text")
            texts = texts.filter(pa.array(in_bloom(wanted.value, batch.column("fp").to_numpy()))) if wanted else texts
            for text in texts.to_pylist():
                x = shingles(text, width)
                if len(x) and (key := set_key(x)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(x.view(np.int64))
                if len(sets) == 1024:
                    yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["set_key", "members"])
                    keys, sets = [], []
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["set_key", "members"])

    return run


class _Confirm:
    """What confirms links between representatives: their sketches, and their full sets for those that need them."""

    def __init__(self, docs: DataFrame, standing: DataFrame, width: int, similarity: float):
        self.docs, self.standing, self.width = docs, standing, width
        self.percent, self.reach = round(similarity * 100), reach(similarity)

    def sets(self, rows: DataFrame) -> DataFrame:
        """row, n_shingles, members of each distinct row of rows."""
        ends = written(self.standing.select("row", "fp", "set_key", "n_shingles").join(rows.distinct(), "row"), "ends")
        suspects, texts = Suspects(ends.select("fp")), self.docs.select("fp", "text")
        if not suspects.bits:
            texts, _ = suspects.among(texts, F.col("fp"))
        sets = texts.mapInArrow(_sets(self.width, suspects.bits), "set_key binary, members array<long>")
        sets = sets.groupBy("set_key").agg(F.first("members").alias("members"))
        return written(ends.join(sets, "set_key").select("row", "n_shingles", "members"), "sets", even=False)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs a, b that are links."""
        sketch = self.standing.select("row", "sketch")
        a = sketch.select(F.col("row").alias("a"), F.col("sketch").alias("sa"))
        b = sketch.select(F.col("row").alias("b"), F.col("sketch").alias("sb"))
        differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
        pairs = written(pairs.join(a, "a").join(b, "b").where(differ <= self.reach).select("a", "b"), "pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("row")))
        a = sets.select(F.col("row").alias("a"), F.col("n_shingles").alias("na"), F.col("members").alias("ma"))
        b = sets.select(F.col("row").alias("b"), F.col("n_shingles").alias("nb"), F.col("members").alias("mb"))
        both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("ma", "mb")))
        links = written(both.where(100 * F.col("common") >= self.percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "links")
        discard(pairs)
        discard(sets)
        return links


def _cells(part: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each cell of a group."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(part[order])) + 1)


def _sketched(most: int):
    """The rows of each cell that have a partner in another component, an outsider or for outsiders a member, with a near sketch."""

    def run(rows: pa.Table) -> pa.Table:
        part, component = rows.column("part").to_numpy(), rows.column("component").to_numpy()
        outsider = rows.column("outsider").to_numpy(zero_copy_only=False)
        sketch = rows.column("sketch").combine_chunks().values.to_numpy().view(np.uint64).reshape(-1, SKETCH_BITS // 64)
        keep = np.zeros(len(part), bool)
        for at in _cells(part):
            out, all_ = at[outsider[at]], at[~outsider[at]]
            for k in range(0, len(out), 32):
                o = out[k : k + 32]
                differ = np.bitwise_count(sketch[o][:, None, :] ^ sketch[all_][None, :, :]).sum(axis=2, dtype=np.int32)
                near = (differ <= most) & (component[o][:, None] != component[all_][None, :])
                keep[o] |= near.any(axis=1)
                keep[all_] |= near.any(axis=0)
        return rows.select(["part", "row", "component", "outsider"]).filter(pa.array(keep))

    return run


def _linked(percent: int):
    """Links of each cell between components, by full sets; no more than join them."""

    def run(rows: pa.Table) -> pa.Table:
        part, row, component = (rows.column(c).to_numpy() for c in ("part", "row", "component"))
        outsider = rows.column("outsider").to_numpy(zero_copy_only=False)
        members = rows.column("members").combine_chunks()
        flat, ends = members.values.to_numpy(), members.offsets.to_numpy()
        sizes = np.diff(ends)
        links: list[tuple[int, int]] = []
        for at in _cells(part):
            out, all_ = at[outsider[at]], at[~outsider[at]]
            if not len(out) or not len(all_):
                continue
            pool = np.concatenate([flat[ends[k] : ends[k + 1]] for k in all_])
            owner = np.repeat(np.arange(len(all_)), sizes[all_])
            joined: dict[int, int] = {}

            def root(c: int) -> int:
                while c in joined:
                    c = joined[c]
                return c

            for o in out:
                own = np.sort(flat[ends[o] : ends[o + 1]])
                place = np.minimum(np.searchsorted(own, pool), len(own) - 1)
                common = np.bincount(owner[own[place] == pool], minlength=len(all_))
                for k in all_[100 * common >= percent * (sizes[o] + sizes[all_] - common)]:
                    x, y = root(component[o]), root(component[k])
                    if x != y:
                        joined[x] = y
                        links.append((min(row[o], row[k]), max(row[o], row[k])))
        a, b = zip(*links) if links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _place(members: np.ndarray) -> np.ndarray:
    return (members.view(np.uint64) >> np.uint64(64 - TALLY.bit_length() + 1)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall on each place."""
    n = np.zeros(TALLY, np.int64)
    for batch in batches:
        n += np.bincount(_place(batch.column("members").flatten().to_numpy()), minlength=TALLY)
    at = np.flatnonzero(n)
    yield pa.record_batch([pa.array(at), pa.array(n[at])], ["place", "n"])


def first_shingles(members: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles, rare ones first, of which a set at the threshold must hold one if it is no larger, and how many of them if it is no smaller."""
    size = len(members)
    order = np.lexsort((members, n))[: size + percent * size // -100 + 1]
    return order, size + 2 * percent * size // -(100 + percent) + 1


def _firsts(tally, percent: int):
    """key, row, first of each first shingle that others may hold; first: a larger set must hold one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                keys, rows, firsts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for row, members in zip(batch.column("row").to_numpy(), batch.column("members")):
                    x = members.values.to_numpy()
                    n = tally.value[_place(x)]
                    order, short = first_shingles(x, n, percent)
                    shared = n[order] > 1
                    keys.append(x[order][shared])
                    rows.append(np.full(shared.sum(), row))
                    firsts.append((np.arange(len(order)) < short)[shared])
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (keys, rows, firsts)], ["key", "row", "first"])

    return run


def _dealt_anew(crowded: DataFrame, confirm: _Confirm) -> DataFrame:
    """key, row, component, first: the members of crowded buckets in buckets of their first shingles."""
    sets = confirm.sets(crowded.select("row"))
    counted = sets.select("members").mapInArrow(_tally, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # at most TALLY rows
    tally = np.zeros(TALLY, np.int64)
    tally[counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    firsts = sets.select("row", "members").mapInArrow(_firsts(sets.sparkSession.sparkContext.broadcast(tally), confirm.percent), "key long, row long, first boolean")
    return written(firsts.join(crowded, "row").select("key", "row", "component", "first"), "first-shingles", even=False)


def _opened(members: DataFrame) -> DataFrame:
    """Buckets with members of several components: on the left those outside the largest, or those marked first where these are fewer."""
    per = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.count_if("first").alias("firsts"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("members"), F.sum("firsts").alias("firsts"))
    outside = F.col("members") - F.col("top.n")
    opened = top.where("top.n < members and firsts > 0").select(
        "key",
        F.col("top.component").alias("largest"),
        (F.col("firsts") < outside).alias("by_first"),
        F.ceil(F.col("members") / CHUNK).cast("long").alias("chunks"),
        F.ceil(F.least(outside, "firsts") / CHUNK).cast("long").alias("left_chunks"),
    )
    return written(opened, "opened")


def _in_cells(members: DataFrame, opened: DataFrame) -> DataFrame:
    """row, component, outsider, part: the left of each bucket beside all of it, in cells."""
    outside = F.when(F.col("by_first"), F.col("first")).otherwise(F.col("component") != F.col("largest"))
    rows = members.join(opened, "key").withColumn("outside", outside)
    chunk, left_chunk = F.pmod(F.xxhash64("row"), F.col("chunks")), F.pmod(F.xxhash64("row"), F.col("left_chunks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    member = rows.select("key", "row", "component", F.lit(False).alias("outsider"), chunk.alias("i"), every("left_chunks").alias("j"))
    left = rows.where("outside").select("key", "row", "component", F.lit(True).alias("outsider"), every("chunks").alias("i"), left_chunk.alias("j"))
    return member.unionByName(left).select("row", "component", "outsider", F.xxhash64("key", "i", "j").alias("part"))


def _left_over(shared: DataFrame, found: DataFrame, confirm: _Confirm) -> DataFrame:
    """Links a, b between components that the stars left apart."""
    component = F.coalesce("component", F.col("row"))
    in_bucket = shared.where("n > 2").select("key", "row").join(found.withColumnRenamed("node", "row"), "row", "left").select("key", "row", component.alias("component"))
    in_bucket = written(in_bucket.withColumn("first", F.lit(True)), "members")
    opened = _opened(in_bucket)
    cells, used = _in_cells(in_bucket, opened.where("left_chunks = 1")), [in_bucket, opened]
    crowded = opened.where("left_chunks > 1")
    if not crowded.isEmpty():
        anew = _dealt_anew(written(in_bucket.join(crowded.select("key"), "key", "left_semi").select("row", "component").distinct(), "crowded"), confirm)
        opened = _opened(anew)
        cells, used = cells.unionByName(_in_cells(anew, opened)), [*used, anew, opened]
    cells = written(cells, "cells")
    group = F.pmod("part", F.lit(max(1, cells.count() // GROUP_ROWS))).alias("g")
    sketched = cells.join(confirm.standing.select("row", "sketch"), "row").withColumn("g", group)
    near = written(sketched.groupBy("g").applyInArrow(_sketched(confirm.reach), "part long, row long, component long, outsider boolean"), "near")
    group = F.pmod("part", F.lit(max(1, near.count() // (GROUP_ROWS // 4)))).alias("g")
    sets = confirm.sets(near.select("row"))
    full = near.join(sets, "row").withColumn("g", group)
    links = written(full.groupBy("g").applyInArrow(_linked(confirm.percent), "a long, b long"), "links")
    for table in [*used, cells, near, sets]:
        discard(table)
    return links


def near_duplicates(documents: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """row, doc_id, fp (xxhash64 of the text), n_shingles, component_id, kept of each document."""
    docs = documents_of(documents).withColumn("fp", F.xxhash64("text"))
    signed = written(docs.mapInArrow(_signatures(width), _SIGNATURE), "signatures", even=False)
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"))
    classes = written(classes, "classes")
    standing = written(signed.drop("doc_id").join(classes.select("row"), "row", "left_semi"), "standing", even=False)
    confirm = _Confirm(docs, standing, width, similarity)

    members = standing.select("row", F.explode("bands").alias("key"))
    # The least of row xor key is another member's row in each band, and a plain minimum for Spark.
    least = F.min(F.col("row").bitwiseXOR(F.col("key")))
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), least.alias("least")).where("n > 1")
    buckets = written(buckets.select("key", "n", F.col("least").bitwiseXOR(F.col("key")).alias("pivot")), "buckets")
    shared = written(members.join(buckets, "key"), "shared")
    stars = shared.where("row <> pivot").select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b")).distinct()
    found = components(confirm.links(stars))
    more = _left_over(shared, found, confirm)
    for table in (buckets, shared, standing):
        discard(table)
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    of_class = classes.join(found.withColumnRenamed("node", "row"), "row", "left").select("set_key", "doc_id", F.coalesce("component", F.col("row")).alias("component"))
    least = written(of_class.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    named = of_class.join(least, "component").select("set_key", "component_id")
    component_id = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        signed.select("row", "doc_id", "fp", "n_shingles", "set_key")
        .join(named, "set_key", "left")
        .select("row", "doc_id", "fp", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))
    )


def one_of_each(documents: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents but for those whose component has one with a smaller doc_id; of repeated rows one stays. Columns as they were."""
    decided = near_duplicates(documents, width, similarity).select("doc_id", "fp", "kept", "n_shingles")
    decided = written(decided, "decided")
    fp = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    again = decided.groupBy("doc_id", "fp").agg(F.max("kept").alias("kept"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles")).where("not kept or (n > 1 and n_shingles > 0)")
    again = written(again, "dropped")
    asked, others = Suspects(again.select("fp")).among(documents, fp)
    whole = asked.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"), fp.alias("fp"), F.col("doc_id").cast("long").alias("id"))
    asked = whole.join(again.select("doc_id", F.col("fp").alias("f"), "kept"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("fp") == F.col("f")), "left")
    place = F.row_number().over(Window.partitionBy("id", "fp").orderBy("id"))
    stay = asked.withColumn("place", place).where("kept is null or (kept and place = 1)")
    return others.unionByName(stay.select("whole.*"))
