"""Approximate nearest neighbours over shifted space-filling curves, then an exact check by bounds.

1. An index of CURVES orderings. Each projects the vectors on DIMENSIONS directions of its own, fitted as a
   random rotation of the principal directions of a bounded sample, shifts them, cuts them into cells, and takes the
   cell's place on a Hilbert curve. Spark range-partitions the rows by place; a row's rank is
   its position in the whole ordering, so equal keys make no large groups.
2. For each query and curve the rows within `window` ranks are compared; the best of all curves merge and
   are reranked by their exact inner products.
3. Along the first curve, rows in blocks of BLOCK ranks have a centre, a radius and so a bound on the inner
   product of any query with any of their rows. Blocks whose bound reaches a query's k-th best so far
   are compared whole. So the answer misses nothing; where vectors have structure few blocks
   are read. On directions drawn evenly from a sphere of many dimensions no ordering separates near from
   far and most blocks are read: queries against all rows, in blocks.

All work on a block is done in groups of at most about BLOCK rows and of one of the even parts, of at most about PART queries, that
the queries are dealt to, in slices of at most SLICE queries; a block's rows are sent once for each part. Past MOST_BLOCKS blocks, neighbouring blocks share one bound, so what is
broadcast stays below MOST_BLOCKS centres.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
Ties go to the smaller vec_id. Rows that repeat a vec_id with another vector are rows of their own; repeats of a row count once. A query's own
row is left out by vec_id.
Rows with null vec_id take no part. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CURVES = 4
DIMENSIONS = 8
BITS = 7
WINDOW = 128
BLOCK = 2048
SLICE = 512
PART = 1 << 16
MOST_BLOCKS = 4096
SAMPLE = 20_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of cells, each coordinate below 2**bits; columns * bits must be at most 63.

    Works down the bit planes: each step inverts or exchanges the lower bits as the curve's
    turn at that plane asks, then the planes are read in Gray code.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for axis in range(n):
            set_ = (x[axis] >> plane & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] >> plane & 1, (1 << plane) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for axis in range(n):
            place = place << 1 | (x[axis] >> plane & 1)
    return place


class Curves:
    """Projections, shifts and scales of the orderings, from a sample of vectors."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = 11):
        rng = np.random.default_rng(seed)
        wide = sample.shape[1]
        k = min(DIMENSIONS, wide)
        self.mean = sample.mean(axis=0)
        spread, axes = np.linalg.eigh(np.cov(sample - self.mean, rowvar=False).reshape(wide, wide) if len(sample) > 1 else np.eye(wide))
        axes = axes[:, np.argsort(-spread)]
        self.directions = []
        for c in range(curves):
            # the first curve keeps the principal directions, the others mix further ones in
            among = axes[:, : min(wide, k * (1 + c))]
            self.directions.append((among @ np.linalg.qr(rng.normal(size=(among.shape[1], k)))[0]) if c else among)
        seen = [(sample - self.mean) @ d for d in self.directions]
        self.low = [s.min(axis=0) for s in seen]
        self.step = [(s.max(axis=0) - s.min(axis=0) + 1e-9) / (2**BITS - 2) for s in seen]
        self.shift = rng.uniform(0, 1, (curves, k))

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """A column for each curve."""
        out = []
        for d, low, step, shift in zip(self.directions, self.low, self.step, self.shift):
            cell = np.floor(((vectors - self.mean) @ d - low) / step + shift)
            out.append(hilbert(np.clip(cell, 0, 2**BITS - 1), BITS))
        return np.stack(out, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the vectors that take part, all of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    good = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
        & F.exists("v", lambda x: x != 0)
    )
    wide = good.groupBy(F.size("v").alias("wide")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "wide").first()
    return good.where(F.size("v") == (wide.wide if wide else 0))


def _placed(curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = curves.value.places(_matrix(batch.column("v"))) if batch.num_rows else np.zeros((0, 1), np.int64)
            ends = pa.array(np.arange(0, places.size + 1, places.shape[1], dtype=np.int32))
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(places.ravel()))], ["vec_id", "v", "places"])

    return run


def ranked(placed: DataFrame, curve: int) -> DataFrame:
    """vec_id, v, rank (from 0) in the ordering of one curve."""
    spark = placed.sparkSession
    ordered = placed.select("vec_id", "v", F.col("places")[curve].alias("place")).repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id")
    ordered = written(ordered.select("vec_id", "v", F.monotonically_increasing_id().alias("at")), f"curve{curve}", even=False)
    part = F.shiftright("at", 33).alias("part")
    sizes = ordered.groupBy(part).agg(F.count("*").alias("n"))
    # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = {r.p: r.start for r in starts.collect()}
    if not starts:
        return ordered.select("vec_id", "v", F.lit(0).cast("long").alias("rank"))
    start = spark.createDataFrame(list(starts.items()), "p long, start long")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(start), F.shiftright("at", 33) == F.col("p")).select("vec_id", "v", rank.alias("rank"))


def _best(k: int, query: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of v for each row of q, without a query's own id; ties to smaller ids.

    Products of matrices may differ in the last bits from place to place, so all that reach the k-th within a hair
    are summed again in order of the components, which gives equal vectors equal scores.
    """
    scores = np.where(ids[None, :] == query[:, None], -np.inf, scores)
    edge = np.full((len(scores), 1), -np.inf)
    if scores.shape[1] > k:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        edge = edge - 1e-9 * np.where(np.isfinite(edge), np.abs(edge), 0) - 1e-300
    i, j = np.nonzero((scores >= edge) & (scores > -np.inf))
    exact = np.add.accumulate(q[i] * v[j], axis=1)[:, -1] if len(i) else np.zeros(0)
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return query[i[best]], ids[j[best]], exact[best]


def _found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])


def _windows(k: int, window: int):
    """Queries of a stretch of one ordering against the rows within `window` ranks of them."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("rank", "ascending"), ("vec_id", "ascending")])
        ids, rank = (rows.column(c).to_numpy() for c in ("vec_id", "rank"))
        asks, v = rows.column("asks").to_numpy(zero_copy_only=False), _matrix(rows.column("v"))
        data, at = np.flatnonzero(~asks), np.flatnonzero(asks)
        out = []
        for s in range(0, len(at), 64):
            q = at[s : s + 64]
            a, b = np.searchsorted(rank[data], (rank[q[0]] - window, rank[q[-1]] + window + 1))
            near = data[a:b]
            scores = v[q] @ v[near].T
            scores = np.where(np.abs(rank[near][None, :] - rank[q][:, None]) <= window, scores, -np.inf)
            out.append(_best(k, ids[q], v[q], ids[near], v[near], scores))
        return _found(out)

    return run


def _neighbours_on(ordered: DataFrame, every: int, k: int, window: int) -> DataFrame:
    stretch = max(8 * window, BLOCK)
    rows = ordered.select("vec_id", "v", "rank", F.lit(False).alias("asks"), F.floor(F.col("rank") / stretch).alias("part"))
    first, last = F.floor((F.col("rank") - window) / stretch), F.floor((F.col("rank") + window) / stretch)
    asks = ordered.where(F.col("vec_id") % every == 0).select("vec_id", "v", "rank", F.lit(True).alias("asks"), F.explode(F.sequence(first, last)).alias("part"))
    return rows.unionByName(asks).groupBy("part").applyInArrow(_windows(k, window), "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _summaries(blocks: DataFrame) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        v = _matrix(rows.column("v"))
        centre = v.mean(axis=0)
        radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-9) + 1e-12
        return pa.table({"bound": rows.column("bound").slice(0, 1), "centre": pa.array([centre], pa.list_(pa.float64())), "radius": [radius], "n": [len(v)]})

    return blocks.groupBy("bound").applyInArrow(run, "bound long, centre array<double>, radius double, n long")


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist() if len(x) else []
    return list(zip(at, [*at[1:], len(x)]))


def _asked(summary, per: int):
    """The blocks that a query has to see: (block, part, slice of queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, centres, radii, last = summary.value
        for whole in batches:
            parts = whole.column("part").to_numpy()
            for s, e in ((s, e) for a, b in _runs(parts) for s, e in ((k, min(k + SLICE, b)) for k in range(a, b, SLICE))):
                batch = whole.slice(s, e - s)
                v, floor_ = _matrix(batch.column("v")), batch.column("floor").to_numpy(zero_copy_only=False).astype(float)
                reach = v @ centres.T + np.sqrt((v**2).sum(axis=1))[:, None] * radii[None, :]
                open_ = reach >= np.where(np.isnan(floor_), -np.inf, floor_ - 1e-9 * np.abs(floor_))[:, None]
                ids = batch.column("vec_id").to_numpy()
                for b in np.flatnonzero(open_.any(axis=0)):
                    q = open_[:, b]
                    for block in range(bounds[b] * per, min((bounds[b] + 1) * per, last + 1)):
                        yield pa.record_batch(
                            [pa.array([block], pa.int64()), pa.array([parts[s]], pa.int32()), pa.array([ids[q].tobytes()]), pa.array([v[q].tobytes()]), pa.array([floor_[q].tobytes()])],
                            ["block", "part", "ids", "vectors", "floors"],
                        )

    return run


def _checked(k: int):
    """Queries that ask for a block against all its rows; only rows that reach a query's k-th best so far are kept."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return _found([])
        ids, v = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"))
        out = []
        for packed_ids, packed, floors in zip(*(asked.column(c).to_pylist() for c in ("ids", "vectors", "floors"))):
            q = np.frombuffer(packed_ids, np.int64)
            asking = np.frombuffer(packed).reshape(len(q), -1)
            scores = asking @ v.T
            floor_ = np.frombuffer(floors)
            scores = np.where(scores >= np.where(np.isnan(floor_), -np.inf, floor_ - 1e-9 * np.abs(floor_))[:, None], scores, -np.inf)
            out.append(_best(k, q, asking, ids, v, scores))
        return _found(out)

    return run


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, curves: int = CURVES, window: int = WINDOW, complete: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for each vec_id divisible by `every`.

    complete=False leaves out step 3 and gives what the curves' windows alone find.
    """
    vectors = written(usable(embeddings), "vectors", even=False)
    spark = vectors.sparkSession
    n = vectors.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    share = min(1.0, SAMPLE / n)
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).select("v").toArrow()
    if not sample.num_rows:
        sample = vectors.select("v").limit(100).toArrow()
    placing = spark.sparkContext.broadcast(Curves(_matrix(sample.column("v")), curves))
    placed = written(vectors.mapInArrow(_placed(placing), "vec_id long, v array<double>, places array<long>"), "placed", even=False)
    orders = [ranked(placed, c) for c in range(curves)]
    found = _neighbours_on(orders[0], every, k, window)
    for order in orders[1:]:
        found = found.unionByName(_neighbours_on(order, every, k, window))
    found = written(_top(found.dropDuplicates(["query_id", "vec_id", "score"]), k), "near")
    if complete:
        floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("floor"))
        queries = vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
        queries = queries.join(floors, F.col("vec_id") == F.col("q"), "left")
        parts = max(1, -(-vectors.where(F.col("vec_id") % every == 0).count() // PART))
        part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part")
        queries = queries.select("vec_id", "v", "floor", part).sortWithinPartitions("part")
        per = -(-(n // BLOCK + 1) // MOST_BLOCKS)
        block = F.floor(F.col("rank") / BLOCK)
        blocks = orders[0].select("vec_id", "v", block.alias("block"), F.floor(block / per).alias("bound"))
        s = _summaries(blocks.select("bound", "v")).toArrow() if per == 1 else _merged(blocks, per).toArrow()
        summary = (s.column("bound").to_numpy(), _matrix(s.column("centre")), s.column("radius").to_numpy(), (n - 1) // BLOCK)
        asked = queries.mapInArrow(_asked(spark.sparkContext.broadcast(summary), per), "block long, part int, ids binary, vectors binary, floors binary")
        more = asked.groupBy("block", "part").cogroup(_sent(blocks, asked).groupBy("block", "part")).applyInArrow(_checked(k), "query_id long, vec_id long, score double")
        found = written(found.select("query_id", "vec_id", "score").unionByName(more), "checked")
    return _top(found.select("query_id", "vec_id", "score").distinct(), k).select("query_id", "rank", "vec_id", "score")


def _sent(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of each block once for each part with a query that asks for it, and not for the others."""
    wanted = asked.select(F.col("block").alias("at"), F.col("part").alias("to")).distinct()
    return blocks.join(wanted, F.col("block") == F.col("at")).select("vec_id", "v", "block", F.col("to").alias("part"))


def _merged(blocks: DataFrame, per: int) -> DataFrame:
    """Bounds over `per` blocks each: summaries by block first, so that no group grows."""
    own = _summaries(blocks.select(F.col("block").alias("bound"), "v")).withColumn("block", F.col("bound"))

    def run(rows: pa.Table) -> pa.Table:
        c, r, n = _matrix(rows.column("centre")), rows.column("radius").to_numpy(), rows.column("n").to_numpy()
        centre = np.average(c, axis=0, weights=n)
        radius = float((np.sqrt(((c - centre) ** 2).sum(axis=1)) + r).max()) * (1 + 1e-9)
        return pa.table({"bound": rows.column("bound").slice(0, 1), "centre": pa.array([centre], pa.list_(pa.float64())), "radius": [radius], "n": [int(n.sum())]})

    return own.withColumn("bound", F.floor(F.col("block") / per)).groupBy("bound").applyInArrow(run, "bound long, centre array<double>, radius double, n long")
