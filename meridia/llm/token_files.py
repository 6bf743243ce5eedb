"""Token-id files of byte or bit planes.

A shard holds the ids of a range of documents in ascending doc_id order:

    magic | chunk | chunk | ... | footer | length of the footer, 8 bytes | magic

A chunk is a block of CHUNK ids (the last is shorter), little-endian unsigned 32-bit, turned
into 4 byte planes (or 32 bit planes) that are each compressed with zstandard. The footer, also
compressed, is the index: for each chunk its offset, its number of ids and the compressed size
of each plane; for each document its doc_id, whether that is null, and its number of ids.
A reader that wants a range of ids reads the footer and the chunks that hold it.

Tasks write the shards to the shared folder under names of their own and return manifest rows;
only files in the manifest count, so tasks that run twice do no harm.

Null text is an empty document: its end id alone. Null doc_ids come last. Rows that repeat a
doc_id are documents of their own, ordered by text hash. An empty table has shards without documents.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of, new_folder, written
from .tokenize import encoder

MAGIC = b"MPLANES1"
CHUNK = 1 << 16
PLANES = ("byte", "bit")
#: Bytes of text of a shard: not less while there are fewer shards than shuffle partitions, and not more, about.
LEAST, MOST = 16 << 20, 256 << 20


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """4 byte planes or 32 bit planes, lowest first; bits of a plane in order of ids, lowest bit first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [p.tobytes() for p in raw.T]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in bits.T]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class ShardWriter:
    def __init__(self, sink, kind: str = "byte", chunk: int = CHUNK):
        import zstandard

        self.sink, self.kind, self.chunk = sink, kind, chunk
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        self.chunks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.chunk:
            self._flush(self.n_held - self.n_held % self.chunk)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for k in range(0, n, self.chunk):
            part = ids[k : min(k + self.chunk, n)]
            planes = [self.pack(p) for p in to_planes(part, self.kind)]
            self.chunks.append([self.at, len(part), [len(p) for p in planes]])
            for p in planes:
                self.sink.write(p)
                self.at += len(p)
        self.held, self.n_held = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        if self.n_held:
            self._flush(self.n_held)
        footer = self.pack(json.dumps({"kind": self.kind, "chunks": self.chunks, "doc_ids": self.doc_ids, "lengths": self.lengths}).encode())
        self.sink.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class ShardReader:
    """source: a random-access file."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        source.seek(size - 8 - len(MAGIC))
        tail = source.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a shard of token ids, or one that was not closed")
        n = int.from_bytes(tail[:8], "little")
        source.seek(size - 8 - len(MAGIC) - n)
        self.index = json.loads(self.unpack(source.read(n)))

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][k]
        self.source.seek(at)
        return from_planes([self.unpack(self.source.read(s)) for s in sizes], n, self.index["kind"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids start to stop of the shard; reads only the chunks that hold them."""
        found, at = [], 0
        for k, (_, n, _) in enumerate(self.index["chunks"]):
            if at < stop and at + n > start:
                found.append(self.chunk(k)[max(0, start - at) : stop - at])
            at += n
        return np.concatenate(found) if found else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Each document and its ids, in parts; holds one chunk at a time."""
        part, k = np.zeros(0, "<u4"), 0
        for doc_id, n in zip(self.index["doc_ids"], self.index["lengths"]):
            got = []
            while n:
                if not len(part):
                    part, k = self.chunk(k), k + 1
                got.append(part[:n])
                part, n = part[n:], n - len(got[-1])
            yield doc_id, got


def _write(folder: str, path: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.planes"
        tok, end = encoder(path), end_id.to_bytes(4, "little")
        with store.open_output_stream(f"{root}/{name}") as sink:
            writer = ShardWriter(sink, kind)
            for batch in batches:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tok.column(batch.column("text"))):
                    writer.add(doc_id, ids + end)
            writer.close()
        tok.rest()
        pa.default_memory_pool().release_unused()  # the worker stays for other stages
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "n_docs": len(writer.lengths), "n_tokens": sum(writer.lengths)}])

    return run


def write_token_files(documents: DataFrame, path: str, folder: str, end_id: int = 2, kind: str = "byte") -> DataFrame:
    """Encodes the documents and writes the shards into folder, a URI that driver and executors share. Gives the manifest."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    docs = documents_of(documents).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // MOST), min(-(-size // LEAST), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(ranged.mapInArrow(_write(folder, path, end_id, kind), "shard long, file string, n_docs long, n_tokens long"), "manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with store.open_input_file(f"{root}/{name}") as source:
                    rows: list[tuple] = []
                    for doc_id, parts in ShardReader(source).documents():
                        n = crc = 0
                        for p in parts:
                            crc, n = zlib.crc32(p.tobytes(), crc), n + len(p)
                        rows.append((doc_id, start, n, crc))
                        start += n
                        if len(rows) == 50_000:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files alone.

    The running totals are over the manifest, a row for each shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("shard", "file", "before").where("n_docs > 0")
    tasks = max(1, manifest.count())
    return shards.repartition(tasks).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, path: str, end_id: int = 2, kind: str = "byte") -> DataFrame:
    """Writes the files into a new shared folder and reads them back."""
    folder = new_folder(documents.sparkSession, "token-files")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_token_files(write_token_files(documents, path, folder, end_id, kind), folder)
