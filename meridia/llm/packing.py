"""Packing: bounded-space online best fit with free cuts.

Each task keeps at most OPEN open windows of SIZE ids. A document gives full windows first; its
rest goes to the open window with the least room that still holds it. When none holds it
and OPEN windows are open, the fullest is filled up with the head of the rest and emitted.
At its end a task joins its open windows into full ones and passes on at most one window
that is not full. These leftovers are packed again, FAN_IN of them a group, round by round,
until one group is left; its last ids form windows of the powers of two of their number,
which need no padding.

Each document is its ids and an end id, so null and empty texts are one piece of one id.
Repeated rows and equal or null doc_ids are separate documents. An empty table gives no
piece. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, written
from .tokenize import encoder

SIZE = 1024
OPEN = 16
FAN_IN = 256
_WIDTH = 4

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
_TYPES = [pa.int64()] * 7 + [pa.binary()]


class Packer:
    """Windows are [used, pieces]; a piece is (doc_id, start, ids, doc_tokens). full(pieces) gets each full window."""

    def __init__(self, full, size: int = SIZE, most: int = OPEN):
        self.full, self.size, self.most, self.open = full, size, most, []

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        at, n = 0, len(ids) // _WIDTH
        while n - at >= self.size:
            self.full([(doc_id, start + at, ids[at * _WIDTH : (at + self.size) * _WIDTH], doc_tokens)])
            at += self.size
        while at < n:
            need = n - at
            best = max((w for w in self.open if w[0] + need <= self.size), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most:
                self.open.append(best := [0, []])
            if best is None:
                best = max(self.open, key=lambda w: w[0])
            take = min(need, self.size - best[0])
            best[1].append((doc_id, start + at, ids[at * _WIDTH : (at + take) * _WIDTH], doc_tokens))
            best[0] += take
            at += take
            if best[0] == self.size:
                self.open = [w for w in self.open if w is not best]
                self.full(best[1])

    def close(self) -> list[tuple]:
        """Joins the open windows; gives the pieces of the one that stays short of full."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open, self.most = [], 1
        for p in pieces:
            self.add(*p)
        return self.open[0][1] if self.open else []


class _Rows:
    def __init__(self, first: int):
        self.next, self.columns = first, [[] for _ in _NAMES]

    def emit(self, pieces: list[tuple], keep: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // _WIDTH
            for c, v in zip(self.columns, (doc_id, start, n, zlib.crc32(ids), doc_tokens, None if keep else self.next, offset, ids if keep else None)):
                c.append(v)
            offset += n
        self.next += not keep

    def batch(self) -> pa.RecordBatch:
        made = pa.record_batch([pa.array(c, t) for c, t in zip(self.columns, _TYPES)], _NAMES)
        self.columns = [[] for _ in _NAMES]
        return made


def _pack_texts(path: str, end_id: int, size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, end = encoder(path), end_id.to_bytes(_WIDTH, "little")
        rows = _Rows(TaskContext.get().partitionId() << 40)
        packer = Packer(rows.emit, size, most)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tok.column(batch.column("text"))):
                packer.add(doc_id, 0, ids + end, len(ids) // _WIDTH + 1)
            yield rows.batch()
        rows.emit(packer.close(), keep=True)
        yield rows.batch()
        tok.rest()
        pa.default_memory_pool().release_unused()  # the worker stays for other stages

    return run


def _powers(pieces: list[tuple], full) -> None:
    """Cuts the last ids into windows of falling powers of two."""
    left = sum(len(p[2]) for p in pieces) // _WIDTH
    for power in (1 << k for k in reversed(range(left.bit_length())) if left >> k & 1):
        room, window = power, []
        while room:
            doc_id, start, ids, doc_tokens = pieces.pop(0)
            take = min(room, len(ids) // _WIDTH)
            window.append((doc_id, start, ids[: take * _WIDTH], doc_tokens))
            if take * _WIDTH < len(ids):
                pieces.insert(0, (doc_id, start + take, ids[take * _WIDTH :], doc_tokens))
            room -= take
        full(window)


def _merge(base: int, size: int, last: bool):
    """Packs the leftovers of one group, at most FAN_IN windows that are not full."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        part = table.column("part")[0].as_py()
        rows = _Rows(base + (part << 20))
        packer = Packer(rows.emit, size, OPEN)
        for piece in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
            packer.add(*piece)
        rest = packer.close()
        if last:
            _powers(rest, rows.emit)
        else:
            rows.emit(rest, keep=True)
        made = pa.Table.from_batches([rows.batch()])
        return made.append_column("part", pa.array([part] * made.num_rows, pa.int64()))

    return run


def pack(documents: DataFrame, path: str, end_id: int = 0, size: int = SIZE, most: int = OPEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    docs = documents_of(documents)
    first = docs.mapInArrow(_pack_texts(path, end_id, size, most), PIECE).withColumn("part", F.spark_partition_id().cast("long"))
    first = written(first, "packed", even=False)
    done = first.where("sequence_id is not null").drop("ids", "part")
    left = first.where("sequence_id is null")
    groups = left.agg(F.max("part")).first()[0]
    step = 0
    while groups is not None:
        step, groups = step + 1, groups // FAN_IN
        again = left.withColumns({"sequence_id": F.col("part"), "part": F.floor(F.col("part") / FAN_IN)})
        merged = again.groupBy("part").applyInArrow(_merge(-(step << 56), size, not groups), f"{PIECE}, part long")
        merged = written(merged, "packed")
        done = done.unionByName(merged.where("sequence_id is not null").drop("ids", "part"))
        left = merged.where("sequence_id is null")
        groups = groups or None
    return done
