"""Token counts: pieces once per distinct pre-token, joined to per-document frequencies.

1. Each task counts the white-space pre-tokens of its documents; Spark sums the counts into
   one row for each distinct pre-token of the corpus.
2. The tokenizer counts the pieces of each distinct pre-token once.
3. The most frequent pre-tokens are broadcast: at most HOT entries, whatever the corpus, those of more than HOT_BYTES
   by their MD5. A document's frequencies of these are summed where it is read.
   All other (document, pre-token, frequency) rows are joined with the pieces by pre-token.
No token id is kept anywhere.

White space never lies in a pre-token of a tokenizer that drops it, so the pieces of a text
are those of its white-space-separated runs. ASCII capitals are folded first, except in texts
that hold "<|", because special strings are matched before lower-casing.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and equal or null doc_ids each
give a row of their own. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, frequent, written
from .tokenize import load

HOT = 1 << 18
HOT_BYTES = 48
#: Distinct pre-tokens that a task holds before it passes their counts on.
HELD = 1_000_000


def pre_tokens(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return (raw if b"<|" in raw else raw.lower()).split()


def task_counts(split, most: int = HELD):
    """Occurrences of what split finds in the texts of a task: rows word, n; a word may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(split(text))
                if len(held) > most:
                    yield out()
        yield out()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for batch in batches:
            words = [w.decode("utf-8", "surrogatepass") for w in batch.column("word").to_pylist()]
            n = [len(e) for e in tok.encode_batch_fast(words, add_special_tokens=False)]
            yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array(n, pa.int32())], ["word", "n", "pieces"])

    return run


def hot_key(word: bytes) -> bytes:
    """The word, or for a long one a mark that no pre-token has and its digest."""
    return word if len(word) <= HOT_BYTES else b" " + hashlib.md5(word).digest()


def _frequencies(hot):
    """For each document one row with its size and the pieces of its hot pre-tokens, and one for each other pre-token.

    The first kind has a word of its own that no pre-token can be: a space and the row's key.
    """
    names = ["key", "doc_id", "n_bytes", "word", "freq"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces = hot.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                total, rare = 0, {}
                for word, n in Counter(pre_tokens(text)).items():
                    p = pieces.get(word if len(word) <= HOT_BYTES else hot_key(word))
                    if p is None:
                        rare[word] = n
                    else:
                        total += p * n
                n_bytes = len(text.encode("utf-8", "surrogatepass"))
                rows[0] += [key] * (1 + len(rare))
                rows[1] += [doc_id] + [None] * len(rare)
                rows[2] += [n_bytes] + [None] * len(rare)
                rows[3] += [b" %d" % key, *rare]
                rows[4] += [total, *rare.values()]
                key += 1
                if len(rows[0]) > 200_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types)], names)
                    rows = [[], [], [], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types)], names)

    return run


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """A row for each distinct pre-token: word, n (occurrences), pieces. Written to the shared folder."""
    counts = docs.select("text").mapInArrow(task_counts(pre_tokens), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counts.mapInArrow(_pieces(path), "word binary, n long, pieces int"), "pre-tokens", even=False)


def token_counts(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each document."""
    docs = documents_of(documents)
    spark = docs.sparkSession
    words = vocabulary(docs, path)
    long = F.concat(F.lit(" ").cast("binary"), F.unhex(F.md5("word")))
    key = F.when(F.octet_length("word") <= HOT_BYTES, F.col("word")).otherwise(long).alias("key")
    hot = spark.sparkContext.broadcast({bytes(r.key): r.pieces for r in frequent(words, HOT).select(key, "pieces").toLocalIterator()})
    rows = docs.mapInArrow(_frequencies(hot), "key long, doc_id long, n_bytes long, word binary, freq long")
    return (
        rows.join(words.select("word", "pieces"), "word", "left")
        .groupBy("key")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("freq") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
